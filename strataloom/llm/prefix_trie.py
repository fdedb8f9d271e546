"""Prefix trie of conversations in succinct level-order tries, with rollups over subtrees.

A conversation is rebuilt from the first turns of another and its own later ones; a node of the trie is a distinct
sequence of turns. Texts stay where they are read: a turn is its digest and its length from there on.

1. One streaming pass over the turns in order chains their digests, so that a prefix has a digest of 16 bytes. Two of
   n prefixes share one with odds of n squared to 2 to the power 129, which is taken as never.
2. Prefixes with more than `heavy` conversations are the upper levels: as many nodes at most as there are turns for
   each `heavy` of them. Below each the subtrees are light, and are dealt to shards by their tops.
3. A shard is a LOUDS trie: its nodes level by level, a bit for each child and a zero after each node's children, with
   arrays of labels, lengths and numbers of conversations that end there. Parents come from the bits by rank and
   select; walking the levels from the last to the first, add.at carries members, leaves and saved tokens up.
4. What the tops have gathered is summed by parent and enters the trie of the upper levels as its leaves' start.

Ids of the conversations that end at a node are joined in chunks of a bounded range of ids, which one task per node
then feeds to its digest one after the other, so that no list of them is ever held.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import written

#: A conversation takes from none up to SHARED - 1 of its first turns from the first of its STRIDE.
SHARED, STRIDE = 6, 100
#: A prefix with more conversations is of the upper levels; with very many turns as many as leave UPPER such prefixes.
HEAVY, UPPER = 1000, 200_000
#: Rows of turns for a shard.
SHARD_ROWS = 20_000
#: Conversation ids of one chunk.
CHUNK = 1 << 16
ROOT = bytes(16)


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, k, label, chars) of every turn of the rebuilt conversations, in order of k, and a row with k = 0 for each.

    Rows of one turn number stand in the order of their roles and then of the digests of their texts.
    """
    text = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), text.alias("text"),
        F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("chars"))
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = written(turns.select("c", F.row_number().over(order).cast("long").alias("k"), F.unhex(F.sha2(F.concat("text", "role"), 256)).alias("label"), "chars"), "trie-turns")
    taken = F.crc32(F.col("c").cast("string").cast("binary")) % SHARED
    each = turns.where("k = 1").select("c", taken.alias("h"), (F.col("c") - F.col("c") % STRIDE).alias("base"))
    first = turns.where((F.col("c") % STRIDE == 0) & (F.col("k") < SHARED)).groupBy(F.col("c").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("k", "label", "chars"))).alias("first"))  # SHARED - 1 at most
    head = each.join(first, "base").select("c", F.explode(F.slice("first", F.lit(1), F.col("h").cast("int"))).alias("t")).select("c", "t.k", "t.label", "t.chars")
    own = turns.where(F.col("k") > taken).select("c", (F.col("k") + SHARED).alias("k"), "label", "chars")
    top = each.select("c", F.lit(0).cast("long").alias("k"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("chars"))
    return written(top.unionByName(head).unionByName(own), "trie-steps")


PATHS = "c long, depth long, prefix binary, parent binary, chars long, ends long, top binary, top_depth long"


def _paths(heavy: set[bytes]):
    """Turns in order -> the prefix that each ends; top: the first prefix of its conversation that is not heavy, if it has been reached."""

    def run(batches):
        held, now, depth, prefix, top, top_depth = None, None, 0, ROOT, None, None
        for b in batches:
            rows = []
            for c, label, chars in zip(b.column("c").to_pylist(), b.column("label").to_pylist(), b.column("chars").to_pylist()):
                if c != now:
                    now, depth, parent, prefix, top, top_depth = c, 0, None, ROOT, None, None
                else:
                    depth, parent, prefix = depth + 1, prefix, hashlib.blake2b(prefix + label, digest_size=16).digest()
                if top is None and prefix not in heavy:
                    top, top_depth = prefix, depth
                if held is not None:
                    rows.append((*held[:5], int(held[0] != c), *held[5:]))
                held = (c, depth, prefix, parent, chars, top, top_depth)
            yield _table(rows)
        yield _table([(*held[:5], 1, *held[5:])] if held is not None else [])

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in PATHS.split(", ")))
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.record_batch([pa.array(c, pa.int64() if k == "long" else pa.binary()) for c, k in zip(cols, kinds)], names=list(names))


TRIE = "shard long, n long, bits binary, labels binary, parents binary, depths binary, chars binary, least binary, members binary, leaves binary, saved binary, outside binary"


def louds(level: np.ndarray, parent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a forest -> (their order by levels, bits of the trie whose root has the forest's tops as children).

    level: 0 for tops; parent: number of the parent's node, -1 for tops; rank: order among siblings.
    """
    n = len(level)
    place, order, made = np.full(n + 1, -1), [], 0
    place[-1] = -1  # the parent of tops
    by_level = np.argsort(level, kind="stable")
    edge = np.searchsorted(level[by_level], np.arange(int(level.max()) + 2 if n else 1))
    for a, b in zip(edge[:-1], edge[1:]):
        own = by_level[a:b]
        own = own[np.lexsort((rank[own], place[parent[own]]))]
        place[own] = np.arange(made, made + len(own))
        made += len(own)
        order.append(own)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    children = np.bincount(place[parent[order]] + 1, minlength=n + 1)  # the root first
    bits = np.ones(2 * n + 1, bool)
    bits[np.cumsum(children + 1) - 1] = False
    return order, bits


def opened(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(parent of each node but the root, children of each, runs of nodes of each level) of a LOUDS trie; node 0 is its root."""
    zeros = np.flatnonzero(~bits)
    children = np.diff(np.concatenate([[-1], zeros])) - 1
    parent = np.searchsorted(zeros, np.flatnonzero(bits))  # zeros before each child's bit
    end, levels = np.cumsum(children) + 1, [(0, 1)]
    while levels[-1][1] < len(children):
        levels.append((levels[-1][1], int(end[levels[-1][1] - 1])))
    return parent, children, levels


def _build(t: pa.Table) -> pa.Table:
    """The nodes of a shard -> its trie."""
    prefix = t["prefix"].combine_chunks()
    parent = pc.index_in(t["parent"].combine_chunks(), value_set=prefix).fill_null(-1).to_numpy().astype(np.int64)
    rank = np.empty(len(prefix), np.int64)
    rank[pc.sort_indices(prefix).to_numpy()] = np.arange(len(prefix))
    col = {c: t[c].to_numpy() for c in ("depth", "top_depth", "chars", "least", "members", "leaves", "saved", "outside")}
    order, bits = louds(col["depth"] - col["top_depth"], parent, rank)
    labels = prefix.take(pa.array(order))
    above = t["parent"].combine_chunks().take(pa.array(order)).fill_null(ROOT)
    cut = [col[c][order].astype(np.int64).tobytes() for c in ("depth", "chars", "least", "members", "leaves", "saved", "outside")]
    row = [t["shard"][0].as_py(), len(order), np.packbits(bits).tobytes(), b"".join(labels.to_pylist()), b"".join(above.to_pylist()), *cut]
    names, kinds = zip(*(x.split() for x in TRIE.split(", ")))
    return pa.table({n: pa.array([x], pa.int64() if k == "long" else pa.binary()) for n, k, x in zip(names, kinds, row)})


NODES = ("prefix binary, parent binary, is_top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long")


def _rolled_up(batches):
    """Tries -> their nodes with the rollups."""
    for b in batches:
        for r in b.to_pylist():
            n = r["n"]
            parent, children, levels = opened(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=2 * n + 1).astype(bool))
            depth, chars, least, members, leaves, saved, outside = (
                np.concatenate([[0], np.frombuffer(r[c], np.int64)]) for c in ("depths", "chars", "least", "members", "leaves", "saved", "outside"))
            least[0] = np.iinfo(np.int64).max
            children = children + outside
            leaves = leaves + (children == 0)
            for lo, hi in reversed(levels[1:]):
                up = parent[lo - 1 : hi - 1]
                saved[lo:hi] += (members[lo:hi] - 1) * chars[lo:hi]
                for x in (members, leaves, saved):
                    np.add.at(x, up, x[lo:hi])
                np.minimum.at(least, up, least[lo:hi])
            top = parent == 0
            for i in range(0, n, 1 << 16):
                own = slice(i + 1, min(n, i + (1 << 16)) + 1)
                at = slice(own.start - 1, own.stop - 1)
                digests = [pa.array([r[c][16 * k : 16 * k + 16] for k in range(at.start, at.stop)], pa.binary()) for c in ("labels", "parents")]
                yield pa.record_batch(
                    [*digests, pa.array(top[at]), pa.array(least[own]), pa.array(depth[own]), pa.array(least[parent[at]], mask=top[at]),
                     *(pa.array(x[own]) for x in (members, children, leaves, saved))],
                    names=[x.split()[0] for x in NODES.split(", ")])


def _digests(batches):
    """(prefix, chunk, ids) in order -> (prefix, digest of all ids)."""
    now, held, out = None, None, []
    for b in batches:
        out = []
        for prefix, ids in zip(b.column("prefix").to_pylist(), b.column("ids").to_pylist()):
            if prefix != now:
                if held is not None:
                    out.append((now, held.hexdigest()))
                now, held = prefix, hashlib.sha256(ids.encode())
            else:
                held.update(b"," + ids.encode())
        yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["prefix", "ends_sha256"])
    if held is not None:
        yield pa.record_batch([pa.array([now], pa.binary()), pa.array([held.hexdigest()], pa.string())], names=["prefix", "ends_sha256"])


def tries(steps: DataFrame, heavy: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tries of the shards, of the upper levels, nodes of the shards, paths) of what rebuilt() has made."""
    in_order = steps.repartition("c").sortWithinPartitions("c", "k").select("c", "label", "chars")
    n = steps.count()
    heavy = max(HEAVY, n // UPPER) if heavy is None else heavy
    upper = in_order.mapInArrow(_paths(set()), PATHS).groupBy("prefix").count().where((F.col("count") > heavy) | (F.col("prefix") == F.lit(ROOT)))
    upper = {r["prefix"] for r in upper.select("prefix").toLocalIterator()}  # n / heavy at most
    paths = written(in_order.mapInArrow(_paths({bytes(x) for x in upper}), PATHS), "trie-paths")
    nodes = paths.groupBy("prefix").agg(
        *(F.max(c).alias(c) for c in ("parent", "depth", "chars", "top", "top_depth")), F.min("c").alias("least"), F.sum("ends").alias("members"))
    nodes = written(nodes, "trie-nodes")
    zero = F.lit(0).cast("long")
    light = nodes.where("top is not null").withColumns({
        "shard": F.pmod(F.xxhash64("top"), F.lit(1 + n // SHARD_ROWS)), "leaves": zero, "saved": zero, "outside": zero})
    shards = written(light.groupBy("shard").applyInArrow(_build, TRIE), "trie-shards")
    below = written(shards.mapInArrow(_rolled_up, NODES), "trie-below")
    tops = below.where("is_top").groupBy(F.col("parent").alias("prefix")).agg(
        F.sum("n_convs").alias("more"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("outside"))
    above = nodes.where("top is null").join(tops, "prefix", "left").select(
        "prefix", "parent", "depth", zero.alias("top_depth"), "chars", "least", (F.col("members") + F.coalesce("more", zero)).alias("members"),
        *(F.coalesce(c, zero).alias(c) for c in ("leaves", "saved", "outside")), F.lit(-1).cast("long").alias("shard"))
    return shards, written(above.groupBy("shard").applyInArrow(_build, TRIE), "trie-upper"), below, paths


def prefix_nodes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 heavy: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conversation id belong to none and are left out. A null role or text is empty. Turns of one number,
    or without one, stand in the order of their roles and then of the digests of their texts; repeated rows are turns of
    their own. The remainder of a negative id has its sign. A conversation that has no turn when rebuilt is a member of
    the root. An empty table gives no rows, not even a root; other columns are ignored.
    """
    steps = rebuilt(conversations, conv_col, turn_col, role_col, text_col)
    _, upper, below, paths = tries(steps, heavy)
    above = written(upper.mapInArrow(_rolled_up, NODES), "trie-above")
    owner = F.broadcast(above.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("owner")))  # the upper levels, which are few
    nodes = below.join(owner, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "owner")).drop("owner").unionByName(above)
    ends = paths.where("ends = 1").groupBy("prefix", F.floor(F.col("c") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list("c")).alias("ids"))
    ends = ends.select("prefix", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    ends = ends.repartition("prefix").sortWithinPartitions("prefix", "chunk").select("prefix", "ids").mapInArrow(_digests, "prefix binary, ends_sha256 string")
    out = nodes.join(ends, "prefix", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select(F.col("conv_id").alias(conv_col), "depth", F.col("parent_conv_id").alias(f"parent_{conv_col}"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
