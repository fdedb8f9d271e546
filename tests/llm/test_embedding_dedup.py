import numpy as np
import pyarrow as pa

from strataloom.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, k string, mult long"


def brute(rows):
    n = len(rows)
    usable = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(np.float32(rows[i][1]), np.float64) for i in (a, b))
                link[a, b] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[a], *(comp[b] for b in np.flatnonzero(link[a]))], key=lambda c: rows[c][0]) for a in range(n)]
        if new == comp:
            break
        comp = new
    return sorted((rows[a][0], int(link[a].sum()), rows[comp[a]][0], rows[a][0] == rows[comp[a]][0]) for a in range(n))


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 24))
    rows = []
    for i in range(180):
        v = centres[i % 6] + rng.standard_normal(24) * (0.12 if i % 3 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(300 + i, rows[0][1], 0) for i in range(40)]  # copies
    rows += [(400, [2 * x for x in rows[0][1]], 0), (401, None, 0), (402, [0.0] * 24, 0), (403, [float("nan")] * 24, 0), (404, [None] + [1.0] * 23, 0),
             (405, rows[0][1], None), (406, [1.0, 2.0], 0), (407, [1.0, 2.0], 0), (408, [float("inf")] + [1.0] * 23, 1), (409, [], 1)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, embedding_dedup.near_vectors(df).collect())) == brute(rows)
    assert embedding_dedup.near_dedup(df).count() == sum(r[3] for r in brute(rows))


def pairs_at_the_threshold(n, dim=64):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = rng.standard_normal((n, dim))
    o -= (o * x).sum(axis=1, keepdims=True) * x
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    return x, 0.93 * x + np.sqrt(1 - 0.93**2) * o


def test_calibrated_recall():
    """Of random pairs at the threshold nearly all reach the collision count."""
    _, window, least = embedding_dedup.calibration()
    x, y = pairs_at_the_threshold(4000)
    d = np.abs((x - y) @ embedding_dedup.directions(64))
    assert ((d <= window).sum(axis=1) >= least).mean() > 0.999


def test_recall_of_the_tables():
    """For labels of any size nearly all pairs at the threshold share a bucket, and few others do."""
    x, y = pairs_at_the_threshold(2000)
    for n in (600, 5_000, 100_000, 5_000_000):
        both = np.concatenate([x, y]).astype(np.float32)
        batch = pa.record_batch(
            [pa.array(np.arange(len(both))), pa.array(np.full(len(both), n)), pa.array(np.full(len(both), 64)), pa.array(list(both), pa.list_(pa.float32()))],
            names=["k", "n", "dim", "embedding"])
        out = next(embedding_dedup._place([batch]))
        keys = out.column("keys").flatten().to_numpy().reshape(len(both), -1)
        assert (keys[:2000] == keys[2000:]).any(axis=1).mean() > 0.99
        chance = (keys[:1999] == keys[1:2000]).mean()
        assert chance * n < 3 * embedding_dedup.BLOCK


def test_collisions_equal_differences():
    rng = np.random.default_rng(3)
    p, q = rng.standard_normal((70, 32)), rng.standard_normal((50, 32))
    assert (embedding_dedup.collisions(p, q, 0.7) == (np.abs(q[:, None] - p[None]) <= 0.7).sum(axis=2)).all()


def test_repeated_and_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (1, v, 0), (None, v, 0), (2, [-1.0, 2.0, 3.0], 0), (None, None, 0), (3, v, 1)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA)
    got = sorted(map(tuple, embedding_dedup.near_vectors(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True), (None, 0, None, True), (3, 0, 3, True)], key=repr)


def test_empty_table(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
