import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataloom.llm import queries, token_store
from strataloom.llm.common import fresh_path
from tests.llm.conftest import odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, rows):
    out, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), ids))
        start += len(ids)
    return out


def test_query_equals_library(spark, library, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = sorted(map(tuple, queries.op5_token_ids(spark, sf).collect()))
    assert got == [(i, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, n, ids in want(library, rows)]


def test_odd_rows_many_blocks(spark, odd, library, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 500)
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 2000)
    path = fresh_path(spark, "ids")
    token_store.write_ids(odd, path, PATH)
    got = [(r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in token_store.read_ids(spark, path).collect()]
    rows = sorted(((i, t) for i, t, _ in odd_rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert sorted(got, key=lambda x: x[1]) == want(library, rows)


def test_cut_texts_equal_whole_texts(library):
    rnd = random.Random(4)
    cut = token_store.TextIds.of(PATH)
    texts = ["", " ", "\n", "a\n\nb", "a \nb", " a", "a ", "a  b", "it's, don't. x'", "½. ²,", "<|endoftext|> a", "…! a…", "日本。 語.", None]
    texts += ["".join(rnd.choice("ab.,  \n't9é½_!　日") for _ in range(rnd.randint(1, 30))) for _ in range(2000)]
    for t, raw in zip(texts, cut.all(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000, 300_000])
def test_block_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype("<u4")
    counts = np.bincount(ids, minlength=1)
    table = token_store.normalised(counts) if n else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    raw = token_store.encode_block(ids, table, lanes=256, every=16)
    t = token_store.Table(token_store.pack_table(*table))
    assert (token_store.decode_block(raw, t) == ids).all()
    marks = token_store.block_checkpoints(raw)
    parts = [token_store.decode_block(raw, t, k, k + 1) for k in range(marks)]
    assert (np.concatenate(parts or [ids]) == ids).all()
    if n > 1000:
        assert len(raw) < 3 * n
        broken = bytearray(raw)
        broken[len(raw) // 2] ^= 1
        with pytest.raises(ValueError):
            token_store.decode_block(bytes(broken), t)


def test_empty_table(spark, none):
    path = fresh_path(spark, "ids")
    token_store.write_ids(none, path, PATH)
    assert token_store.read_ids(spark, path).collect() == []
