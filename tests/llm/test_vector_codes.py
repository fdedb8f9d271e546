import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from strataloom.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, id long, v string"


def brute(rows):
    """In Python integers, entry by entry."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by_id = defaultdict(list)
    for i, v, _ in kept:
        if i is not None:
            by_id[i].append(v)
    seeds = [min(by_id[i]) for i in sorted(by_id)[:256]]
    dim = len(seeds[0])
    odd = [(i, lab) for i, v, lab in kept if len(v) != dim]
    kept = [r for r in kept if len(r[1]) == dim]
    w = dim // 4
    books = [[s[p * w : (p + 1) * w] for s in seeds if len(s) == dim] for p in range(4)]

    def best(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(4):
        for p in range(4):
            groups = defaultdict(list)
            for _, v, _ in kept:
                x = v[p * w : (p + 1) * w]
                groups[best(x, books[p])[0]].append(x)
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for i, v, lab in kept:
        found = [best(v[p * w : (p + 1) * w], books[p]) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), lab))
        total[lab] += out[-1][2]
    labels = {lab for _, lab in odd}
    assert labels <= set(total)
    return sorted([(i, c, e, total[lab], sha) for i, c, e, lab in out] + [(i, None, None, total[lab], sha) for i, lab in odd], key=repr)


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 6, "y") for r in rows], SCHEMA).repartition(3)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16) * (3 if i % 7 else 0.01)], i % 3 or None) for i in range(340)]
    rows += [(400 + i, rows[0][1], 1) for i in range(30)]  # copies: ties between entries
    rows += [(5, rows[9][1], 2), (5, rows[5][1], 2), (None, rows[7][1], 1)]  # a repeated id, a repeated row, no id
    rows += [(-1, None, 1), (-2, [float("nan")] * 16, 1), (-3, [None] + [1.0] * 15, 2), (-4, [float("inf")] * 16, 2), (900, [1.0], 1), (901, [], 2)]
    got, _ = vector_codes.compress(make(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_few_vectors_and_ties(spark):
    rows = [(3, [0.5] * 8, 1), (1, [0.5] * 8, None), (2, [-0.0004] * 8, None)]
    got, books = vector_codes.compress(make(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert {r.code for r in got.where("vec_id <> 2").collect()} == {"00" * 4}
    back = {r.vec_id: r.vector for r in vector_codes.decoded(got, books).collect()}
    assert back[3] == [0.5] * 8 and back[2] == [-1 / 1024] * 8


@pytest.mark.parametrize("scale", [1, 1000, 1 << 20, 1 << 26])
def test_screening_is_exact(scale):
    """Near ties far beyond single precision are resolved as in integers."""
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale + 1, (500, 16))
    book = x[rng.integers(0, 40, 256)] + rng.integers(-1, 2, (256, 16))
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    at, far = vector_codes.nearest(x, book)
    assert (at == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_empty_unusable_and_too_large(spark):
    assert vector_codes.compress(make(spark, []))[0].count() == 0
    assert [tuple(r) [:3] for r in vector_codes.compress(make(spark, [(None, [1.0] * 4, 1), (1, None, 1)]))[0].collect()] == [(None, None, None)]
    with pytest.raises(ValueError):
        vector_codes.compress(make(spark, [(1, [1e30] * 4, 1)]))
    with pytest.raises(ValueError):
        vector_codes.compress(make(spark, [(1, [1.0] * 6, 1)]))


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").where("vec_id < 60").collect()]
    got, _ = vector_codes.compress(make(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert queries.QUERIES["op13_vector_codes"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
