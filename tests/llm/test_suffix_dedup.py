import hashlib
import random

import numpy as np

from strataloom.llm import suffix_dedup
from tests.llm.conftest import make, odd_rows, words


def brute(rows):
    starts: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                starts[s] = min(starts.get(s, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and starts[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(map(repr, out))


def check(docs, rows):
    assert sorted(repr(tuple(r)) for r in suffix_dedup.remove_repeats(docs).collect()) == brute(rows)


def test_odd_rows(odd):
    check(odd, odd_rows())


def test_many_runs_and_reducers(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "KEYS_PER_REDUCER", 40)
    rnd = random.Random(9)
    parts = [words(rnd, 14) for _ in range(6)] + ["aaaa" * 30, "\0" * 70, "é" * 40]
    rows = [(rnd.randint(0, 60), "".join(rnd.choice(parts)[rnd.randint(0, 9) :] + words(rnd, 3) for _ in range(rnd.randint(1, 4))), "s") for _ in range(90)]
    check(make(spark, rows), rows)


def test_front_coding_round_trip_and_merge_order():
    rng = np.random.default_rng(2)
    runs = []
    for n in (1, 40, 200, 7, 90):
        key = rng.integers(0, 3, (n, suffix_dedup.KEY), dtype=np.uint8)
        key[:, : rng.integers(0, 60)] = 1
        key = np.unique(key, axis=0)
        back, lcp = suffix_dedup.front_decoded(suffix_dedup.front_coded(key))
        assert (back == key).all()
        runs.append(([r.tobytes() for r in key], lcp.tolist()))
    order = suffix_dedup.merged(runs)
    got = [runs[r][0][k] for r, k in order]
    assert got == sorted(x for keys, _ in runs for x in keys)
    assert len(set(order)) == len(order)


def test_texts_kept(odd):
    got = suffix_dedup.remove_repeats(odd, keep_text=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_empty_table(none):
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_texts_do_not_move(spark, odd):
    """The shuffles of whole texts filled the disk: no exchange may stand above them."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffix_dedup.remove_repeats(odd)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    moved = set()
    for i, line in enumerate(plan):
        if line.lstrip(" :+-").startswith("Exchange"):
            j = i + 1
            while j < len(plan) and depth[j] > depth[i]:
                moved.add(plan[j])
                j += 1
    assert moved and not [x for x in moved if "texts" in x]
    assert [x for x in plan if "Scan" in x and "texts" in x]
