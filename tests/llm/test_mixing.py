import re
from collections import defaultdict

from strataloom.llm import mixing
from tests.llm.conftest import make, odd_rows


def brute_targets(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3.0 * sizes[s]) for s in order}
        full |= over


def test_targets_equal_brute_force_and_mix_meets_them(odd):
    want = brute_targets(odd_rows())
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows())
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s]


def test_reruns_agree(odd):
    run = lambda: sorted(repr(tuple(r)) for r in mixing.mix(odd).collect())
    assert run() == run()


def test_rates_are_the_tilt_with_the_right_sum(spark):
    rows = [(i, "w " * (1 + i * i % 37), "ab"[i % 2]) for i in range(400)]
    got = mixing.mix(make(spark, rows)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.rate * r.size for r in own) / own[0].target - 1) < 1e-6
        # one exponent per source: log(rate) / size is the same for all that are below the cap
        slopes = {round(__import__("math").log(r.rate) / r.size, 9) for r in own if r.rate < 2.999}
        assert len(slopes) == 1
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target


def test_copies_become_rows(odd):
    plan = {r.doc_id: r.copies for r in mixing.mix(odd).where("doc_id <> 70").collect()}
    got = defaultdict(int)
    for r in mixing.mixed_documents(odd).where("doc_id <> 70").collect():
        got[r.doc_id] += 1
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert {k: v for k, v in plan.items() if v and k is not None} == {k: v for k, v in got.items() if k is not None}


def test_empty_table(none):
    assert mixing.mix(none).collect() == []
