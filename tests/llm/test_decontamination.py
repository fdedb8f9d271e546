import hashlib
import random
import re

import numpy as np
import pytest

from strataloom.llm import decontamination as dc
from strataloom.llm import queries
from tests.llm.conftest import odd_rows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(11)
    items = [(i, words(rnd, n)) for i, n in enumerate((1, 3, 9, 10, 11, 25, 60, 40, 12))]
    items += [(100, items[5][1].upper()), (101, " - ".join(items[6][1].split(" ")[5:30])), (5, words(rnd, 14)), (None, words(rnd, 12)), (102, ""), (103, None),
              (104, "Ünïcode wörds größer als neun: eins2 drei4 fünf6 sieben8 x"), (105, items[4][1]), (-7, "zz zz zz zz zz zz zz zz zz zz zz zz")]
    docs = [(i, t) for i, t, _ in odd_rows()]
    for k, (_, t) in enumerate(items):
        w = (t or "").split(" ")
        docs += [(1000 + 10 * k + j, f"{words(rnd, 3)}. {t}! {words(rnd, 4)}") for j in range(3)]
        docs.append((2000 + k, " ".join(w[: len(w) // 2] + ["other"] + w[len(w) // 2 :])))
        docs.append((3000 + k, " ".join(w[2:-2])))
    docs += [(4000, " ".join(["zz"] * 40)), (4001, "  ".join(t for _, t in items if t)), (4002, items[3][1][:-1]), (4001, items[6][1]), (None, items[6][1]), (4003, "q " * 20_000 + items[7][1])]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, sha string, spans int").repartition(3)
    return d, spark.createDataFrame(items, "item_id long, text string").repartition(2)


@pytest.mark.parametrize("block", [1 << 25, 300])
def test_hits_equal_brute_force(spark, monkeypatch, block):
    docs, items = corpus()
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    got = dc.contamination(*frames(spark, docs, items)).collect()
    want = brute(docs, items)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    for r in got:  # spans are disjoint, apart and as long as they say
        assert sum(s["words"] for s in r.spans) == r.n_hit
        assert all(a["start"] + a["words"] < b["start"] for a, b in zip(r.spans, r.spans[1:]))
    kept = dc.decontaminated(*frames(spark, docs, items))
    assert kept.columns == ["doc_id", "text", "sha", "spans"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((x[0] for x in want if not x[5]), key=repr)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for vocabulary, n in ((1, 300), (3, 2000), (50_000, 2000), (1 << 40, 50)):
        w = rng.integers(0, vocabulary, n)
        first = np.unique(np.concatenate([[0, n], rng.integers(0, n, 9)]))
        last = np.repeat(first[1:], np.diff(first))
        order = dc.suffix_array(w, last, 400)
        keys = [tuple(w[i : last[i]]) for i in order]
        assert sorted(order) == list(range(n)) and keys == sorted(keys)


def test_longest_matches(spark):
    rnd = random.Random(5)
    item = words(rnd, 40)
    w = item.split(" ")
    docs = [(1, " ".join(w[3:20])), (2, "pre " + " ".join(w[10:38]) + " post"), (3, " ".join(w[:9]))]
    d, b = frames(spark, docs, [(9, item), (8, "nothing here of the kind at all, is there any word")])
    assert [tuple(r) for r in dc.longest_matches(d, b).collect()] == [("9", 10, 28, 2, 1)]


def test_empty_tables(spark):
    docs, items = corpus()
    d, b = frames(spark, docs, items)
    assert dc.contamination(d.limit(0), b).count() == 0
    assert {tuple(r)[2:6] for r in dc.contamination(d, b.limit(0)).collect()} == {(0, 0, hashlib.sha256(b"").hexdigest(), False)}
    assert dc.decontaminated(d, b.limit(0)).count() == len(docs)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.QUERIES["op12_decontamination"](spark, sf).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == brute(docs, items)
    assert 0 < sum(r.contaminated for r in got) < len(docs)
