import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns whose names clash with those that the operators use inside
    T.StructField("id", T.LongType()), T.StructField("k", T.StringType()), T.StructField("copies", T.LongType()), T.StructField("size", T.LongType())])


def make(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), -1, "x", 9, 9) for i, t, s in rows], DOCS).repartition(3)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies in other case, near copies, shared passages."""
    rnd = random.Random(7)
    base = [words(rnd, n) for n in (1, 3, 5, 12, 40, 80, 120, 200)]
    passage = words(rnd, 30)
    rows = [(1, None, "b"), (2, "", None), (3, " \t\n", "a"), (4, "x", "a"), (5, "ÄÖ é ü", None)]
    rows += [(10 + i, t, "abc"[i % 3]) for i, t in enumerate(base)]
    rows += [(30 + i, t.upper() if i % 2 else t, "hot") for i, t in enumerate(base)]
    for i, t in enumerate(base[4:]):
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        rows.append((50 + i, " ".join(w), "hot"))
    rows += [(60 + i, f"{words(rnd, 6)} {passage} {words(rnd, 5)}", "hot") for i in range(6)]
    rows += [(70, base[5], "hot"), (70, base[5], "hot"), (71, "a " * 3000, "long"), (72, words(rnd, 9000), "long"), (None, base[6], "a")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, odd_rows()).cache()


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, []).cache()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
