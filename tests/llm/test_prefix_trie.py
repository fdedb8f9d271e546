import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strataloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth long, prefix string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            text = text or ""
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        made[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(set)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[v[:d]].add(c)
    children, weight, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            weight[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], weight[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()]


def corpus():
    rnd = random.Random(4)
    texts = ["", "a", "bb", "ccc", "Größe", "x" * 5000, None]
    rows = []
    for c in [*range(0, 60), *range(100, 180), 1005, 100_000, 100_001, 7_000_000, -150, -100, -99, -7, 300, 301, 302]:
        for k in range(rnd.randint(1, 9)):
            rows.append((c, k, rnd.choice(["user", "assistant", None]), rnd.choice(texts)))
    for c in range(500, 640):  # copies, most of them whole
        rows += [(c, k, "user", f"same {k}") for k in range(7 if c % 10 else c % 7 + 1)]
    rows += [(200, None, "user", "late"), (200, None, "system", "first"), (200, 1, "a", "tie"), (200, 1, "a", "eit"), (200, 1, "a", "tie"), (None, 1, "user", "nobody")]
    rows += [(250, k, "user", str(k % 3)) for k in range(400)] + [(251, k, "user", str(k % 3)) for k in range(401)]
    rows += [(c, 0, "user", "only") for c in range(800, 812)]  # turnless unless h = 0, as the first of them has one turn
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "p") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("heavy", [None, 3, 20])
def test_nodes_equal_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 300)
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    got = prefix_trie.prefix_nodes(frame(spark, corpus()), heavy=heavy)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(corpus()), key=repr)


def test_louds_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 400):
        parent = np.array([rng.integers(-1, i) if i else -1 for i in range(n)], np.int64)
        level = np.zeros(n, np.int64)
        for i in range(n):
            level[i] = level[parent[i]] + 1 if parent[i] >= 0 else 0
        order, bits = prefix_trie.louds(level, parent, np.arange(n))
        up, children, levels = prefix_trie.opened(bits)
        assert [order[p - 1] if p else -1 for p in up] == parent[order].tolist()
        assert children.sum() == n and len(bits) == 2 * n + 1
        assert [level[i] for i in order] == [k for k, (a, b) in enumerate(levels[1:]) for _ in range(b - a)]


def test_empty_and_one_turn(spark):
    assert prefix_trie.prefix_nodes(frame(spark, [])).count() == 0
    rows = [(5, None, None, None)]
    assert sorted(map(tuple, prefix_trie.prefix_nodes(frame(spark, rows)).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_prefix_trie"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)
