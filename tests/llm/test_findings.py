"""Links of near copies: every one is counted, whatever blocks its class is cut into."""

import numpy as np

from strataloom.llm import language_model, set_join
from tests.llm.conftest import make, odd_rows
from tests.llm.test_set_join import brute, spectrum


def counted(docs):
    return sorted(repr((r.doc_id, r.class_id, r.n_links)) for r in set_join.jaccard_classes(docs).collect())


def test_every_link_of_odd_rows_is_counted(odd):
    assert counted(odd) == brute(odd_rows())


def test_every_link_within_and_between_blocks_is_counted(spark, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 16)
    rows = spectrum(120, 4)
    rows += [(200 + i, rows[i][1], "s") for i in range(5)]  # copies of linked texts
    assert counted(make(spark, rows)) == brute(rows)


def test_weights_are_sent_once_a_shard(spark, monkeypatch):
    """What training sends grows with the shards, which follow from the tokens, and not with the partitions of a session; weights are the same."""
    sent = []
    whole = language_model.scaled_sum

    def counted(df, parts, size, blocks=32):
        sent.append((df.rdd.getNumPartitions(), df.select("shard").distinct().count()))
        return whole(df.repartition(11, "shard").sortWithinPartitions("shard"), parts, size, blocks)

    docs = make(spark, [(i, f"a b c{i} " * 40, "s") for i in range(60)])
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 1000)
    own = language_model.fit(docs).weights
    monkeypatch.setattr(language_model, "scaled_sum", counted)
    other = language_model.fit(docs).weights
    assert np.allclose(own, other, atol=1e-5) and own.any()
    assert len(sent) == language_model.ROUNDS and all(1 < n <= p for p, n in sent)


def test_rows_of_several_shards_in_one_batch():
    """A task that holds several shards sends one vector for each, started from the given weights."""
    import pyarrow as pa

    weights, frequent = np.zeros((9, language_model.CLASSES), np.float32), np.zeros(0, np.uint64)
    batch = lambda rows: pa.record_batch([pa.array([s for s, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.large_string())], names=["shard", "text"])
    a, b = [(0, "x y z"), (0, "x")], [(3, "q r")]
    got = list(language_model._train(weights, frequent)([batch(a[:1]), batch(a[1:] + b), batch([])]))
    assert [(s, n) for s, n, _ in got] == [(0, 6.0), (3, 3.0)]
    apart = [next(iter(language_model._train(weights, frequent)(iter(x)))) for x in ([batch(a[:1]), batch(a[1:])], [batch(b)])]
    assert all((x[2] == y[2]).all() for x, y in zip(got, apart))


def test_a_rare_telling_word_counts_in_a_large_sample(spark):
    """A word of few bags, all toxic, settles its documents however many others are learned from."""
    from strataloom.llm import toxicity

    rows = [(i, f"fine day {i % 97}. " + ("foul thing" if i < 6 else "vile thing" if i % 15 == 0 else "good thing"), "s") for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i < 6 or i % 15 == 0)) for i in range(6000)], "doc_id long, toxic int")
    model = toxicity.fit(make(spark, rows), labels)
    got = {r.doc_id: r.score for r in toxicity.score(make(spark, [(1, "foul day", "s"), (2, "vile day", "s"), (3, "fine good thing", "s")]), model).collect()}
    assert got[1] >= 0.5 and got[2] >= 0.5 > got[3]


def test_work_arrays_of_a_stage_stay_small():
    """Workers of stages that follow each other hold little beside the texts: their slices are small whatever the batch."""
    import tracemalloc

    import pyarrow as pa

    from strataloom.llm import toxicity

    texts = pa.array(["a few words that say next to nothing, again and again. " * 50] * 1500, pa.large_string())  # 4 MB
    batch = pa.record_batch([pa.array(range(1500), pa.int64()), texts, pa.array([0] * 1500, pa.int32())], names=["id", "text", "toxic"])
    for work in (toxicity._word_counts, set_join._sketch):
        list(work([batch.slice(0, 10)]))  # tables that are made once
        tracemalloc.start()
        for _ in work([batch]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12 << 20, (work.__name__, peak >> 20)
