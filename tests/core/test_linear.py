"""Work in proportion to the text: offsets, containment and JSON trees of any depth, against plain Python."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from strataloom.functions import payload, text
from strataloom.operators import linking


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700, 60_000])
def test_running_starts(spark, n):
    got = spark.range(1).select(text.running_starts(F.expr(f"filter(sequence(1, {n + 1}), x -> x <= {n})").cast("array<int>")).alias("r")).first()["r"]
    assert got == [k * (k + 1) // 2 for k in range(n)]


def test_offsets_equal_python_and_grow_in_proportion(spark):
    rnd = random.Random(1)
    lines = [" ".join(f"{'ä' * rnd.randint(0, 3)}{rnd.randint(0, 99999)}" for _ in range(n)) for n in (0, 3, 600, 8000, 32_000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, t string")
    found = df.select("k", text.matches(F.col("t"), "([0-9])[0-9]{2}", (0, 1)).alias("m"))
    for r in found.collect():
        assert [tuple(m) for m in r.m] == [(m.start(), m[0], m[1]) for m in re.finditer("([0-9])[0-9]{2}", lines[r.k])]
    seconds = []
    for k in (3, 4, 3, 4):
        at = time.perf_counter()
        found.where(F.col("k") == k).select(F.sum(F.size("m"))).collect()
        seconds.append(time.perf_counter() - at)
    assert seconds[3] < 10 * max(seconds[2], 0.1)


def contained(spark, docs, items):
    d = spark.createDataFrame(docs, "d long, t string").repartition(3)
    i = spark.createDataFrame(items, "i long, p string")
    return sorted(map(tuple, linking.containing(d, "d", "t", i, "i", "p").collect()))


def test_containing_equals_python(spark):
    rnd = random.Random(2)
    words = lambda n: " ".join(rnd.choice(["one", "two", "three", "four", "x", "fünf"]) for _ in range(n))
    docs = [(k, words(rnd.randint(0, 60))) for k in range(120)] + [(200, ""), (201, None), (202, "a"), (203, "zz yy"), (204, "a  b   c d e f g h i j")]
    items = [(k, words(n)) for k, n in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12))] + [(50 + k, t[j : j + m]) for k, (_, t) in enumerate(docs[:30]) for j, m in [(rnd.randint(0, 9), rnd.randint(1, 90))]]
    items += [(90, "a"), (91, "zz"), (92, ""), (93, None), (94, "  b  "), (95, "nowhere at all in any of the texts, that is sure"), (96, "a  b   c d")]
    assert contained(spark, docs, items) == sorted((d, i) for d, t in docs for i, p in items if t is not None and p is not None and p in t)
    assert contained(spark, docs, []) == []
    assert contained(spark, [], items) == []


def test_containing_is_linear_in_one_text(spark):
    rnd = random.Random(3)
    long = [" ".join(f"w{rnd.randint(0, 5000)}" for _ in range(n)) for n in (20_000, 80_000)]
    items = [(1, " ".join(long[1].split(" ")[70_000:70_020])), (2, long[1][1000:1006]), (3, " ".join(long[0].split(" ")[19_000:19_005]))]
    seconds = []
    for k in (0, 1, 0, 1):
        at = time.perf_counter()
        got = contained(spark, [(k, long[k])], items)
        seconds.append(time.perf_counter() - at)
        assert got == sorted((k, i) for i, p in items if p in long[k])
    assert seconds[3] < 5 * seconds[2] + 2


def test_articles_at_any_depth(spark):
    def deep(n, inside):
        for k in range(n):
            inside = {"a": inside} if k % 2 else ["{[\"[", inside]
        return inside

    article = {"id": "7", "title": "t", "html": "<p>[{"}
    rows = [(n, json.dumps(deep(n, article))) for n in (0, 1, 11, 12, 13, 14, 40)] + [(99, "[]"), (98, "no json"), (97, None), (96, "5")]
    df = spark.createDataFrame([(k, j, "7") for k, j in rows], "k int, j string, id string")
    got = {r.k: (r.n_articles, r.n_found, r.status) for r in payload.article_record(df, ["k"], "j", "id").collect()}
    assert got == {n: (1, 1, "ok") for n in (0, 1, 11, 12, 13, 14, 40)}
    assert payload.article_record(df.limit(0), ["k"], "j", "id").count() == 0
