"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on fixed Gaussian directions. For two vectors with cosine c the difference of a
projection is normal with deviation sqrt(2 - 2c), so all shares below follow from the normal and binomial laws:
the calibration does not look at the data.

* Buckets: TABLES cut some projections into cells of WIDTH deviations with a random offset each; the cells of
  one table name a bucket. A label of n vectors has as many projections a table as bring the vectors that share
  a bucket by chance down to BLOCK, and as many tables as leave a pair at the threshold apart in all of them
  with probability APART. A label with at most BLOCK vectors is one bucket. So the work grows as n to the power
  1.23, not 2, but for vectors that really are close: they share buckets, as their links must be counted.
* Collisions: in a bucket each of PROJECTIONS further projections is sorted and the window around each query is
  searched in it. The window holds a share COLLIDE of the pairs at the threshold; pairs that collide as often as
  all but MISS of those do are verified by their cosine in double precision.

Buckets over BLOCK are cut into blocks that meet in tiles. A link is counted in the first table that brings its
vectors together. Tiles return sums and spanning edges, never pairs. Equal vectors of one label are one node
with a multiplicity, so copies are never expanded into pairs.
"""

from __future__ import annotations

from math import ceil, comb, exp, log, pi, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import components, forest, sent_if_small, whole_groups, written

THRESHOLD = 0.93
PROJECTIONS = 32
COLLIDE = 0.95
MISS = 1e-5
BLOCK = 512
WIDTH = 5.0
APART = 1e-3
#: At most so many projections a table; labels too large for it (over a hundred million) have larger buckets.
DEEPEST = 16


def calibration(threshold: float = THRESHOLD) -> tuple[float, float, int]:
    """(deviation of a projected difference at the threshold, window, collisions that a pair must reach)."""
    deviation = sqrt(2 - 2 * threshold)
    missed, least = 0.0, 0
    while missed + (p := comb(PROJECTIONS, least) * COLLIDE**least * (1 - COLLIDE) ** (PROJECTIONS - least)) <= MISS:
        missed, least = missed + p, least + 1
    return deviation, NormalDist(0, deviation).inv_cdf((1 + COLLIDE) / 2), least


def same_cell(width: float) -> float:
    """Probability that two values whose difference is standard normal are in one cell of this width."""
    return 1 - 2 * NormalDist().cdf(-width) - 2 / (sqrt(2 * pi) * width) * (1 - exp(-(width**2) / 2))


def tables(n: int) -> tuple[int, int]:
    """(projections a table, tables) for a label of n vectors."""
    if n <= BLOCK:
        return 0, 1
    near, far = same_cell(WIDTH), same_cell(WIDTH * calibration()[0] / sqrt(2))
    deep = min(DEEPEST, ceil(log(n / BLOCK) / -log(far)))
    return deep, ceil(log(APART) / log(1 - near**deep))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([20240611, dim]).standard_normal((dim, PROJECTIONS))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _place(batches):
    """(k, n, dim, embedding) -> (k, keys, vector): per table the number of the cells that a vector is in."""
    side = WIDTH * calibration()[0]
    for b in batches:
        deep = [tables(n) for n in b.column("n").to_pylist()]
        shape = np.array([(d, *t) for d, t in zip(b.column("dim").to_pylist(), deep)], np.int64).reshape(-1, 3)
        for dim, each, many in np.unique(shape, axis=0).tolist():
            own = b.take(pa.array(np.flatnonzero((shape == (dim, each, many)).all(axis=1))))
            v = own.column("embedding").flatten().to_numpy().reshape(-1, dim)
            keys = np.zeros((len(v), many), np.int64)
            unit = _unit(v)
            for t in range(many if each else 0):
                rng = np.random.default_rng([20240613, dim, t])
                cell = np.floor((unit @ rng.standard_normal((dim, each))) / side + rng.random(each)).astype(np.int64)
                for j in range(each):  # cells are few; their numbers in base 2**16 would do, the mix keeps any
                    keys[:, t] = (keys[:, t] ^ cell[:, j]) * np.int64(0x100000001B3)
            yield pa.record_batch(
                [own.column("k"), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * many, pa.int32()), pa.array(keys.ravel())),
                 pa.array([x.tobytes() for x in v], pa.binary())], names=["k", "keys", "vector"])


def collisions(p: np.ndarray, q: np.ndarray, window: float) -> np.ndarray:
    """How often each row of q is in the window around each row of p, over all projections: one row per row of q."""
    hits = np.zeros((len(q), len(p)), np.uint8)
    at = np.arange(len(p))
    for j in range(p.shape[1]):
        order = np.argsort(q[:, j])
        s = q[order, j]
        turn = np.zeros((len(q) + 1, len(p)), np.int8)
        turn[np.searchsorted(s, p[:, j] - window, "left"), at] = 1
        turn[np.searchsorted(s, p[:, j] + window, "right"), at] -= 1
        hits[order] += np.cumsum(turn[:-1], axis=0, dtype=np.int8).view(np.uint8)
    return hits


def _count_and_verify(kind):
    """Rows in order of tile -> per vector the multiplicities of the vectors it links with, and spanning edges."""
    _, window, least = calibration()

    def tile(own: pa.Table):
        k, mult, side = (own[c].to_numpy() for c in ("k", "mult", "side"))
        keys = own["keys"].combine_chunks().flatten().to_numpy().reshape(len(k), -1)[:, : own["t"][0].as_py()]
        v = _unit(np.frombuffer(b"".join(own["vector"].to_pylist()), kind).reshape(len(k), -1))
        p = v @ directions(v.shape[1])
        if side.any():  # two blocks: queries of one against the other
            q, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        else:
            q = r = np.arange(len(k))
        y, x = np.nonzero(collisions(p[q], p[r], window) >= least)
        x, y = q[x], r[y]
        if not side.any():
            x, y = x[x < y], y[x < y]
        near = np.concatenate([np.zeros(0, bool), *((v[x[i : i + 65536]] * v[y[i : i + 65536]]).sum(axis=1) >= THRESHOLD for i in range(0, len(x), 65536))])
        x, y = x[near], y[near]
        root = forest(len(k), x, y)
        new = ~(keys[x] == keys[y]).any(axis=1)  # no earlier table has counted it
        x, y = x[new], y[new]
        links = np.bincount(x, mult[y], minlength=len(k)) + np.bincount(y, mult[x], minlength=len(k))
        keep = np.flatnonzero((links > 0) | (root != np.arange(len(k))))
        return k[keep], links[keep].astype(np.int64), k[root[keep]]

    def run(batches):
        for t in whole_groups(batches, "tile"):
            ends = np.append(np.flatnonzero(np.diff(t["tile"].to_numpy())) + 1, t.num_rows)
            out, at = [], 0
            for end in ends.tolist():
                out.append(tile(t.slice(at, end - at)))
                at = end
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["k", "links", "root"])

    return run


def _tiles(placed: DataFrame) -> DataFrame:
    """(k, label, dim, keys) -> (tile, t, side, k): every two vectors of a bucket meet in one tile."""
    cells = placed.select("k", "label", "dim", F.posexplode("keys").alias("t", "key")).select("k", "t", F.xxhash64("label", "dim", "t", "key").alias("bucket"))
    cells = written(cells, "vector-cells")
    sizes = cells.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = cells.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("k", F.lit(5)), F.col("blocks")))
    a = F.col("block")
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(
        F.xxhash64("bucket", F.least(a, o), F.greatest(a, o)).alias("tile"), (a > o).cast("int").alias("side")))
    return rows.select("k", "t", F.explode(meet).alias("m")).select("m.tile", "t", "m.side", "k")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors are compared only with equal, non-null labels and equal dimensions. Null and zero vectors and
    those with a null or non-finite component link with nothing and are their own component. Rows that repeat
    an id count one by one; an empty table gives no rows; other columns are ignored.
    """
    parts = F.col("embedding")
    usable = F.col("label").isNotNull() & parts.isNotNull() & (F.size(parts) > 0) & F.forall(
        parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(parts, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("k", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "embedding")))
    rows = written(rows, "vectors")
    nodes = rows.where("k is not null").groupBy("k").agg(
        F.min("id").alias("least"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = written(nodes.withColumn("dim", F.size("embedding")), "vector-nodes")
    sizes = written(nodes.groupBy("label", "dim").agg(F.count("*").alias("n")), "vector-labels")
    wide = isinstance(nodes.schema["embedding"].dataType.elementType, T.DoubleType)
    kind = "double" if wide else "float"
    flat = nodes.join(sent_if_small(sizes), ["label", "dim"]).select("k", "n", "dim", F.col("embedding").cast(f"array<{kind}>"))
    placed = written(flat.mapInArrow(_place, "k long, keys array<long>, vector binary").join(nodes.select("k", "mult", "label", "dim"), "k"), "vector-keys")
    tiles = _tiles(placed).join(placed.select("k", "mult", "keys", "vector"), "k").select("tile", "t", "side", "k", "mult", "keys", "vector")
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", "k")
    found = written(tiles.mapInArrow(_count_and_verify(np.float64 if wide else np.float32), "k long, links long, root long"), "vector-links")
    classes = components(found.select(F.col("k").alias("a"), F.col("root").alias("b")), "vector-classes")
    per = nodes.select("k", "least", "mult").join(found.groupBy("k").agg(F.sum("links").alias("links")), "k", "left").join(
        classes.select(F.col("id").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    first = per.groupBy("root").agg(F.min("least").alias("component_id"))
    per = per.join(first, "root").select("k", "component_id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.where("k is not null").select("id", "k").join(per, "k").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("k is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The rows of vectors that stay: of each component the one with the smallest id."""
    keep = near_vectors(vectors, id_col, vector_col, label_col).where("kept").select(id_col).distinct()
    return vectors.join(keep, vectors[id_col].eqNullSafe(keep[id_col]), "left_semi")
