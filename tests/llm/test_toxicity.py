import zlib

import numpy as np
import pytest

from strataloom.llm import queries, toxicity
from tests.llm.conftest import make


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op10_toxicity(spark, "/root/testdata/sf0.01").collect()


def test_every_document_once_with_its_fold(spark, scored):
    ids = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in scored)
    for r in scored:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_held_out_accuracy(spark, scored):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    own = [(r.predicted, labels[r.doc_id]) for r in scored if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in own) / len(own) >= 0.9
    assert sum(p for p, y in own if y == 1) >= 0.5 * sum(y for _, y in own)


def test_noisy_or_and_offending_sentences(spark):
    weights = np.zeros(toxicity.DIM + 1)
    weights[toxicity.DIM] = -3
    f, *_ = toxicity.bags(np.frombuffer(b"vile", np.uint8), np.array([0, 4]))
    weights[f] = 5
    docs = make(spark, [(1, "Good day. Quite VILE, é vile! Fine", "s"), (2, None, "s"), (3, "", "s"), (4, "no\nno. " * 400 + "vile", "s"), (4, "ok", "s"), (None, "vile", "s")])
    rows = {(r.doc_id, r.n_sentences): r for r in toxicity.score(docs, weights).collect()}
    s = 1 / (1 + np.exp(3)), 1 / (1 + np.exp(-2))
    assert abs(rows[1, 3].score - (1 - (1 - s[0]) ** 2 * (1 - s[1]))) < 1e-9
    assert rows[2, 0].score == rows[3, 0].score == 0 and rows[2, 0].worst_start == -1
    assert abs(rows[4, 801].score - (1 - (1 - s[0]) ** 800 * (1 - s[1]))) < 1e-9
    assert (None, 1) in rows and (4, 1) in rows
    found = toxicity.offending_sentences(docs.where("doc_id = 1"), weights).collect()
    assert [(r.sentence, r.start) for r in found] == [("Quite VILE, é vile", 10)]
    assert {r.doc_id for r in toxicity.clean(docs, weights).collect()} == {1, 2, 3, 4} - {1}
    assert toxicity.clean(docs, weights).columns == docs.columns


def test_gradient_equals_differences(spark):
    rng = np.random.default_rng(0)
    import pyarrow as pa

    texts = [" ".join(rng.choice(list("abcdef"), 9)) + ". " + " ".join(rng.choice(list("abcdef"), 4)) for _ in range(30)]
    batch = pa.record_batch([pa.array(texts), pa.array(rng.integers(0, 2, 30), pa.int32())], names=["text", "toxic"])
    rows = list(toxicity._features([batch]))
    w = rng.standard_normal(toxicity.DIM + 1) * 0.3
    g = toxicity._gradient(w)(rows)
    for at in [*np.flatnonzero(g[: toxicity.DIM])[:3], toxicity.DIM]:
        up, down = w.copy(), w.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        slope = (toxicity._gradient(up)(rows)[toxicity.DIM + 1] - toxicity._gradient(down)(rows)[toxicity.DIM + 1]) / 2e-5
        assert abs(slope - g[at]) < 1e-4 * max(1, abs(slope))


def test_no_labels_and_no_rows(spark, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    weights = toxicity.fit(none, empty, steps=1)
    assert toxicity.score(none, weights).collect() == []
    assert toxicity.toxicity(make(spark, [(1, "a", "s")]), empty).first().predicted == 0


def test_words_of_one_bucket_keep_their_own_weights(spark):
    """A clean word with the same 16 leading bits of its hash neither takes a telling word's weight nor hides it."""

    def bucket(word):
        return int(toxicity.bags(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))[0][0])

    other = next(w for w in (f"w{i}" for i in range(5_000_000)) if bucket(w) == bucket("vile"))
    rows = [(i, f"so vile {i}. fine day", "s") if i % 2 else (i, f"fine {other}. day {i}", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(make(spark, rows), labels)
    asked = make(spark, [(1, "vile", "s"), (2, f"{other} day", "s")])
    got = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert got[1] >= 0.5 > got[2]
