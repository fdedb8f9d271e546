import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from strataloom.llm import pieces, queries
from tests.llm.conftest import odd_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_query_equals_library(spark, library, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows_round_trip(odd, library):
    got = pieces.decode(pieces.encode(odd, PATH), PATH).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text, list(r.ids)) for r in got), key=key) == sorted(((i, t or "", library.encode(t or "")) for i, t, _ in odd_rows()), key=key)


def test_random_texts_equal_library(library):
    rnd = random.Random(1)
    p = pieces.Pieces.of(PATH)
    texts = ["", " ", "  ", "\n", " \n ", "a  b   c    ", "▁▁x", "日本語 テキスト\t\r\n", "</s> <s>", "😀 a😀"]
    texts += ["".join(rnd.choice("ab  \n\ttheingé日;\r){}▁") for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        raw = p.encode(t)
        assert np.frombuffer(raw, "<i4").tolist() == library.encode(t)
        assert p.decode(raw) == library.decode(library.encode(t))


def test_decoding_in_the_same_pass(odd):
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.decoded_sha256)
    encoded = pieces.encode(odd, PATH)
    assert sorted(pieces.encode(odd, PATH, decoded=True, digest=True).collect(), key=key) == sorted(pieces.decode(encoded, PATH, digest=True).collect(), key=key)


def test_long_runs_of_spaces(library):
    text = "a" + " " * 100_000 + "b"
    assert np.frombuffer(pieces.Pieces.of(PATH).encode(text), "<i4").tolist() == library.encode(text)


def test_viterbi_by_scores_equals_all_segmentations(library):
    p = pieces.Pieces.of(PATH)
    scores = {w: p.scores[w] for w in p.scores}

    def best(word):
        table = [0.0] + [-np.inf] * len(word)
        for e in range(1, len(word) + 1):
            table[e] = max([table[e - 1] + p.least if word[e - 1] not in scores else -np.inf, *(table[s] + scores[word[s:e]] for s in range(e) if word[s:e] in scores)])
        return table[-1]

    rnd = random.Random(2)
    for _ in range(200):
        word = "▁" + "".join(rnd.choice("theingandor☃") for _ in range(rnd.randint(1, 10)))
        ids = p.by_score(word)
        known = "".join(c for c in word if c in scores)
        assert sum(p.scores[p.names[i]] for i in ids if p.names[i] in scores) == pytest.approx(best(word) - p.least * (len(word) - len(known)))


def test_empty_table(none):
    assert pieces.decode(pieces.encode(none, PATH), PATH).collect() == []
