import hashlib
from collections import defaultdict

from strataloom.llm import exact_dedup
from tests.llm.conftest import odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(map(repr, out))


def test_groups_equal_brute_force(odd):
    got = exact_dedup.exact_groups(odd).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(odd_rows())


def test_filter_keeps_columns_and_largest_id(odd):
    got = exact_dedup.exact_dedup(odd)
    assert got.columns == odd.columns
    texts = [(r.text or "").translate(LOWER) for r in got.where("doc_id <> 70").collect()]
    assert len(texts) == len(set(texts))


def test_long_copies_split_at_the_last_byte(spark):
    long = "ab" * 40_000
    docs = spark.createDataFrame([(1, long + "x"), (2, long + "y"), (3, long + "x")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_empty_table(none):
    assert exact_dedup.exact_groups(none).collect() == []
