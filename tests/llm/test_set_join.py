import itertools
from collections import defaultdict

from strataloom.llm import set_join
from tests.llm.conftest import make, odd_rows, words


def brute(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    classes = defaultdict(list)
    for x in range(len(rows)):
        classes[find(x)].append(rows[x][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in classes.items()}
    return sorted(repr((rows[x][0], least[find(x)], links[x])) for x in range(len(rows)))


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)]) if w else frozenset()


def check(docs, rows):
    """Classes equal brute force; the links that are named are links, and every text with another one has one."""
    got = set_join.jaccard_classes(docs).collect()
    want = brute(rows)
    assert sorted(repr((r.doc_id, r.class_id)) for r in got) == sorted(repr(eval(w)[:2]) for w in want)
    sets, holders = defaultdict(set), defaultdict(set)
    for i, t, _ in rows:
        sets[i].add(shingles(t))
        holders[shingles(t)].add(i)
    alone = sorted(repr(i) for i, t, _ in rows if not any(s and s != shingles(t) and 5 * len(s & shingles(t)) >= 4 * len(s | shingles(t)) for s in holders))
    assert sorted(repr(r.doc_id) for r in got if r.linked_id is None and r.similarity is None) == alone
    for r in got:
        if r.linked_id is not None:
            assert any(abs(len(a & b) / len(a | b) - r.similarity) < 1e-9 for a in sets[r.rep_id] for b in sets[r.linked_id]) and r.similarity >= 0.8


def spectrum(n, edits, seed=11, size=150):
    """Copies of one text with up to so many changed words: pairs of all similarities around the threshold."""
    import random

    rnd = random.Random(seed)
    base = words(rnd, size).split(" ")
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = words(rnd, 1) + "x"
        rows.append((i, " ".join(w), "s"))
    return rows


def test_odd_rows(odd):
    check(odd, odd_rows())


def test_large_group_of_near_copies_over_many_tiles(spark, monkeypatch):
    import random

    monkeypatch.setattr(set_join, "BUCKET", 16)
    rnd = random.Random(3)
    base = words(rnd, 100).split(" ")
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = words(rnd, 1)
        rows.append((i, " ".join(w), "s"))
    rows += [(200 + i, words(rnd, 60), "s") for i in range(30)]
    check(make(spark, rows), rows)


def test_near_copies_of_long_texts_in_more_than_a_bucket(spark, monkeypatch):
    """Groups that are in the same large bucket at every coordinate keep their links."""
    import random

    monkeypatch.setattr(set_join, "BUCKET", 16)
    rnd = random.Random(5)
    rows = []
    for g in range(10):
        base = words(rnd, 20_000).split(" ")
        for i in range(30):
            w = list(base)
            w[rnd.randrange(len(w))] = f"changed{i}"
            rows.append((30 * g + i, " ".join(w), "s"))
    got = set_join.jaccard_classes(make(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(i, i - i % 30) for i in range(300)]


def test_recall_within_large_buckets(spark, monkeypatch):
    """Pairs that agree in 0.8 of the coordinates, by values that very many other sets have too."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(set_join, "BUCKET", 64)
    rng, n, m = np.random.default_rng(1), 1000, set_join.SIGNATURE
    agreed, common = rng.random((n, m)) < 0.8, rng.integers(0, 2, (n, m))
    sig = np.concatenate([np.where(agreed, common, rng.integers(2, 1 << 30, (n, m))) for _ in range(2)])
    sets = spark.createDataFrame(pd.DataFrame({"k": range(2 * n), "sig": list(sig.astype(np.int32))}), "k long, sig array<int>")
    buckets, _ = set_join._buckets(sets)
    met = set()
    for _, k in buckets.toPandas().groupby("bucket")["k"]:
        k = set(k)
        met |= {x for x in k if x < n and x + n in k}
    assert len(met) >= 0.999 * n
    assert set_join.missed(0.8) ** set_join.RUNS < 1e-3


def test_recall_among_many_near_copies(spark, monkeypatch):
    """Against brute force: buckets are far smaller than the group, and most texts have few links or none."""
    monkeypatch.setattr(set_join, "BUCKET", 32)
    rows = spectrum(700, 14)
    sets = [shingles(t) for _, t, _ in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    cls = {r.doc_id: r.class_id for r in set_join.jaccard_classes(make(spark, rows)).collect()}
    assert len(pairs) > 5000 and sum(cls[a] == cls[b] for a, b in pairs) >= 0.99 * len(pairs)
    linked = {x for p in pairs for x in p}
    want = {r[0]: r[1] for r in map(eval, brute(rows))}
    assert sum(cls[x] == want[x] for x in linked) >= 0.99 * len(linked) and all(cls[x] == x for x in range(len(rows)) if x not in linked)


def test_links_span_the_classes(spark, monkeypatch):
    monkeypatch.setattr(set_join, "BUCKET", 16)
    rows = spectrum(120, 4) + [(500, None, "s"), (501, "", "s"), (None, spectrum(1, 0)[0][1], "s")]
    cls = {r.doc_id: r.class_id for r in set_join.jaccard_classes(make(spark, rows)).collect()}
    links = set_join.jaccard_links(make(spark, rows)).collect()
    text = {i: shingles(t) for i, t, _ in rows}
    assert all(abs(len(text[r.a] & text[r.b]) / len(text[r.a] | text[r.b]) - r.similarity) < 1e-9 and r.similarity >= 0.8 for r in links)
    root = {i: i for i in text if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    different = {}
    for i, t in text.items():
        if i is not None and t:
            different.setdefault(t, i)
    for x, y in itertools.combinations(different.values(), 2):
        assert (find(x) == find(y)) == (cls[x] == cls[y])
    assert len(links) < 60 * len(rows)


def test_near_copy_with_a_null_id(spark):
    base = words(__import__("random").Random(2), 60).split(" ")
    rows = [(1, " ".join(base), "s"), (None, " ".join(base[:-1] + ["changed"]), "s"), (3, " ".join(base[1:] + ["more"]), "s")]
    check(make(spark, rows), rows)


def test_filter_keeps_one_of_each_class(odd):
    kept = set_join.jaccard_dedup(odd)
    classes = {r.doc_id: r.class_id for r in set_join.jaccard_classes(odd).collect()}
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {c for c in classes.values()}


def test_empty_table(none):
    assert set_join.jaccard_classes(none).collect() == []
