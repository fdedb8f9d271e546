"""N-gram Jaccard self-join by chosen paths.

A document is the set of hashes of its five-word shingles (words of textkit; a text of one to four words has
one shingle, a text without words none and links with nothing). Equal sets are one node with a multiplicity.
Sets are embedded into SIGNATURE coordinates by minwise hashing. From the root of each run a set goes down to
a child for every sampled coordinate, each coordinate being taken with probability 1 / (threshold *
SIGNATURE) by a hash of the path, one at least, and the child is named by the path, the coordinate and the
set's value there: a shared token. Buckets with at most BUCKET sets end there and are compared by brute force.

Larger buckets have a pivot: of a few of their sets the one that agrees most with the others. In the first
BLOCK_RUNS runs they are cut into blocks of about BUCKET sets, the pivot being in each, which are compared by
brute force, so that sets near the pivot, or near many others, find a link. In all runs they are split again, but
only on coordinates where a set differs from the pivot: what is like the pivot ends, and what is not meets those that
share what sets it apart. Two linked sets differ in about 13 coordinates, so of those in which a set differs from the pivot it shares all but 13 with its partner, and
at least APART if it is far from the pivot; a coordinate is taken with a probability that makes CHILDREN of them
shared children. Sets that are in several large buckets of a run share out their children among them, so the rows of
a level do not multiply, and as the pivot is typical of its bucket few children are large again. Levels end by
themselves: what has been taken once is what all sets of the bucket agree in. missed() gives the probability that a
run misses a pair, for any number of levels; all RUNS miss one with 4e-5, far below the 0.1 that is allowed, and
tests measure recall against brute force.

Within buckets sketches are compared; pairs that agree in SKETCH_LEAST coordinates (missed with probability
4e-5 at the threshold, 4.1 deviations) make up candidate components. For classes alone a component with at most
BUCKET sets is one tile, a larger one has its buckets as tiles, with the sets that have a candidate there. For the
number of links a component is cut into blocks, and each two of its blocks, and each one, are a tile: every pair of the
component is compared. In a tile all pairs are compared by exact Jaccard similarity; each set's links are counted, and
those of a maximum spanning forest are returned. So a class of any size is given by verified links between its different
texts, with the number of all links of each, and pairs are never rows. The comparisons of a component grow with the
square of its different sets, which the count of its links asks for; a tile takes bounded memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import textkit as tk
from strataloom.llm.common import BROADCAST_BYTES, components, drop_written, forest, free_names, fresh_path, sent_if_small, spanning, whole_groups, written

SHINGLE = 5
FIRST = 11
THRESHOLD = 0.8
SIGNATURE = 64
RUNS = 12
BLOCK_RUNS = 3
CHILDREN = 1.5
POOL = 8
BUCKET = 256
SKETCH_LEAST = 38
#: Different sets, and their shingles, in a block of a component whose links are all counted.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Coordinates in which linked sets differ, and those that a set far from the pivot shares with its partner at least.
DIFFER = round((1 - THRESHOLD) * SIGNATURE)
APART = SIGNATURE - SKETCH_LEAST + 1 - DIFFER
SEED = np.random.default_rng(20240607).integers(1, 1 << 63, size=(2, SIGNATURE), dtype=np.uint64) | np.uint64(1)


def _sets(buf: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and where each text's begin."""
    starts, ends, first = tk.word_bounds(buf, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    sh, at = tk.shingles(tk.word_hashes(buf, starts, ends), first, n)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[new], np.searchsorted(doc[new], np.arange(len(at)))


def _names(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, from its size and two independent sums over its elements."""
    parts = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)]) for v in (sh, tk.mix(sh ^ SEED[0, 0]))]
    a, b = (p[at[1:]] - p[at[:-1]] for p in parts)
    return tk.mix(a + tk.mix(b + np.diff(at).astype(np.uint64))).view(np.int64)


def _signatures(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minwise hashes of non-empty sets, one row per set."""
    out = np.zeros((len(at) - 1, SIGNATURE), np.int32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for i in range(SIGNATURE):
            h = (sh * SEED[0, i] + SEED[1, i]) >> np.uint64(33)
            out[full, i] = np.minimum.reduceat(h, at[full])
    return out


def _sketch(batches):
    for b in batches:
        ids = b.column("id")
        for i, j, buf, offs in tk.byte_slices(b.column("text"), tk.SMALL_SLICE):
            sh, at = _sets(buf, offs)
            sig = _signatures(sh, at)
            yield pa.record_batch(
                [ids.slice(i, j - i), pa.array(_names(sh, at)), pa.array(np.diff(at).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * SIGNATURE, pa.int32()), pa.array(sig.ravel()))],
                names=["id", "k", "n", "sig"])


def missed(similarity: float, levels: int = 100) -> float:
    """Probability that two sets of this similarity share no path of a run down to this many levels of large buckets.

    Down to the first buckets they go together by one of the coordinates they share or as their only child; in a
    large bucket by one of those that they share and the pivot has not, of which CHILDREN are taken on average.
    """
    lost = 0.0
    for _ in range(levels):
        lost = float(np.exp(-CHILDREN * (1 - lost)))
    pick, down = 1 / (THRESHOLD * SIGNATURE), similarity * (1 - lost)
    return (1 - pick * down) ** SIGNATURE - (1 - pick) ** SIGNATURE * down


def _sampled(path, coordinate, share):
    return F.pmod(F.xxhash64(path, coordinate), F.lit(1 << 30)) < F.lit(1 << 30) * share


def _first_children(sets: DataFrame) -> DataFrame:
    """(k, sig) -> (run, path, k, base), the first level of all runs; base is null."""
    rows = sets.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1)))).withColumn("path", F.xxhash64(F.lit("run"), "run"))
    picks = F.filter(F.sequence(F.lit(0), F.lit(SIGNATURE - 1)), lambda i: _sampled(F.col("path"), i, 1 / (THRESHOLD * SIGNATURE)))
    picks = F.when(F.size(picks) > 0, picks).otherwise(F.array(F.pmod(F.xxhash64("path", F.lit("one")), F.lit(SIGNATURE)).cast("int")))
    return rows.select("run", F.explode(F.transform(picks, lambda i: F.xxhash64(F.col("path"), i, F.element_at(F.col("sig"), i + 1)))).alias("path"), "k", F.lit(None).cast("long").alias("base"))


def _pivots(sizes: DataFrame, level: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, pivot) of large buckets: of POOL sets of each, the same ones in all buckets where they are, that which agrees most with the others."""
    large = written(sizes.where(F.col("size") > BUCKET).select("path"), "large-sizes")
    pool = level.select("path", "k").join(sent_if_small(large), "path", "left_semi").groupBy("path").agg(
        F.array(*[F.min_by("k", F.xxhash64("k", F.lit(FIRST + j))) for j in range(POOL)]).alias("k"))
    pool = pool.select("path", F.explode(F.array_distinct("k")).alias("k")).join(sets.select("k", "sig"), "k")
    pool = pool.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "sig"))).alias("pool"))  # POOL at most
    return written(pool.mapInArrow(_medoids, "path long, pivot long"), "pivots")


def _medoids(batches):
    for b in batches:
        out = []
        for pool in b.column("pool").to_pylist():
            sig = np.array([x["sig"] for x in pool])
            out.append(pool[int((sig[:, None] == sig[None]).sum(axis=(1, 2)).argmax())]["k"])
        yield pa.record_batch([b.column("path"), pa.array(out, pa.int64())], names=["path", "pivot"])


def _compared_with_pivots(large: DataFrame, sets: DataFrame) -> DataFrame:
    """(run, path, k, base, size, pivot) of large buckets -> (run, path, k, base, size, pivot, near, down).

    base becomes the pivot for sets that are candidates of it; down lists the children one level down, by what sets k
    apart from the pivot. A set that is in several large buckets of a run goes on in each with a share of its children
    only, so that their number does not grow from level to level. A set's coordinates travel once, to all the buckets
    that it is in; those of the pivots are sent where they fit.
    """
    pivots = written(large.select(F.col("pivot").alias("k")).distinct().join(sets.select("k", "sig"), "k").select(F.col("k").alias("pivot"), F.col("sig").alias("other")), "pivots")
    sent = F.broadcast(pivots) if pivots.count() * 4 * SIGNATURE <= BROADCAST_BYTES else pivots
    rows = large.groupBy("k").agg(F.collect_list(F.struct("run", "path", "base", "size", "pivot")).alias("l")).join(sets.select("k", "sig"), "k")
    again = F.size(F.filter("l", lambda x: x["run"] == F.col("m")["run"]))
    rows = rows.select("k", "sig", "l", F.explode("l").alias("m")).select("k", "sig", again.alias("again"), "m.*").join(sent, "pivot")
    return rows.mapInArrow(_split, "run int, path long, k long, base long, size long, pivot long, near boolean, down array<long>")


def _split(batches):
    for b in batches:
        path = b.column("path").to_numpy().view(np.uint64)
        sig, other = (b.column(c).flatten().to_numpy().reshape(-1, SIGNATURE) for c in ("sig", "other"))
        apart = sig != other
        n = apart.sum(axis=1)
        share = CHILDREN / np.maximum(n - DIFFER, APART) / b.column("again").to_numpy()
        row, i = np.nonzero(apart & (tk.mix(path[:, None] ^ SEED[0]) >> np.uint64(34) < share[:, None] * (1 << 30)))
        child = tk.mix(tk.mix(path[row] ^ SEED[1, i]) + sig[row, i].astype(np.uint64)).view(np.int64)
        near = n <= SIGNATURE - SKETCH_LEAST
        base = pc.if_else(pa.array(near), b.column("pivot"), b.column("base"))
        down = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]), pa.int32()), pa.array(child))
        yield pa.record_batch(
            [*(b.column(c) for c in ("run", "path", "k")), base, b.column("size"), b.column("pivot"), pa.array(near), down],
            names=["run", "path", "k", "base", "size", "pivot", "near", "down"])


def _blocks(large: DataFrame) -> DataFrame:
    """(path, k, base, size, pivot) -> (bucket, k, base): blocks of about BUCKET sets, the pivot in each."""
    n = F.ceil(F.col("size") / BUCKET)
    own = F.array(F.pmod(F.xxhash64("k", "path"), n))
    at = F.when(F.col("k") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(own)
    return large.select(F.explode(F.transform(at, lambda o: F.xxhash64("path", F.lit("block"), o))).alias("bucket"), "k", "base")


def _buckets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, k, base), the buckets of all runs that are compared by brute force, and (a, b), candidates of pivots.

    base is a pivot that k is a candidate of, if there is one: sets of one base are in one component already.
    Small buckets of equal content are taken once. Those that are split are not merged: each has children of
    its own, so a group that stays together keeps the repeats of all runs. Each level's buckets are appended to one
    table, and what the level has written is dropped.
    """
    spark = sets.sparkSession
    path, stars = fresh_path(spark, "jaccard-buckets"), fresh_path(spark, "jaccard-stars")
    keep = lambda rows, to: rows.write.mode("append").option("compression", "zstd").parquet(to)
    level = written(_first_children(sets), "paths")
    keep(sets.select(F.col("k").alias("a"), F.col("k").alias("b")).limit(0), stars)
    while True:
        h = (F.xxhash64("k"), F.xxhash64("k", F.lit(7)))
        sizes = level.groupBy("path").agg(F.count("*").alias("size"), F.bit_xor(h[0]).alias("a"), F.bit_xor(h[1]).alias("b"))
        own = F.when(F.col("size") > BUCKET, F.col("path"))
        sizes = sizes.where("size > 1").groupBy("size", "a", "b", own.alias("own")).agg(F.min("path").alias("path"))
        sizes = written(sizes.select("path", "size"), "path-sizes")
        pivots = _pivots(sizes, level, sets)
        sized = written(level.join(sizes.join(sent_if_small(pivots), "path", "left"), "path"), "sized-paths")
        drop_written(level, sizes, pivots)
        keep(sized.where(F.col("size") <= BUCKET).select(F.col("path").alias("bucket"), "k", "base"), path)
        large = sized.where(F.col("size") > BUCKET)
        if large.isEmpty():
            drop_written(sized)
            break
        large = written(_compared_with_pivots(large, sets), "large-paths")
        drop_written(sized)
        keep(large.where(F.col("near") & (F.col("k") != F.col("pivot"))).select(F.col("k").alias("a"), F.col("pivot").alias("b")).distinct(), stars)
        keep(_blocks(large.where(F.col("run") < BLOCK_RUNS)), path)
        level = written(large.select("run", F.explode("down").alias("path"), "k", "base"), "paths")
        drop_written(large)
    return spark.read.schema("bucket long, k long, base long").parquet(path), spark.read.schema("a long, b long").parquet(stars)


def _pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs within consecutive runs of rows of the given sizes."""
    total = int(sizes.sum())
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    later = begin + np.repeat(sizes, sizes) - np.arange(total) - 1
    x = np.repeat(np.arange(total), later)
    y = np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later) + x + 1
    return x, y


def _sketch_pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of rows of one bucket whose sketches agree in SKETCH_LEAST coordinates."""
    bucket = t["bucket"].to_numpy()
    sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(-1, SIGNATURE)
    edge = np.flatnonzero(np.diff(bucket)) + 1
    sizes = np.diff(np.concatenate([[0], edge, [len(bucket)]]))
    xs, ys, i, row = [], [], 0, 0
    ends = np.cumsum(sizes * (sizes - 1) // 2)
    while i < len(sizes):  # about a quarter of a million pairs at a time
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 18), side="right")))
        x, y = _pairs_within(sizes[i:j])
        x, y = x + row, y + row
        hit = (sig[x] == sig[y]).sum(axis=1, dtype=np.int16) >= SKETCH_LEAST
        xs.append(x[hit])
        ys.append(y[hit])
        row += int(sizes[i:j].sum())
        i = j
    return np.concatenate(xs), np.concatenate(ys)


def _sketch_edges(batches):
    """Rows in order of bucket -> spanning edges of the candidate pairs within each bucket.

    Sets of one base count as one node, as they are in one component anyway.
    """
    for t in whole_groups(batches, "bucket"):
        x, y = _sketch_pairs(t)
        k, bucket, base = t["k"].to_numpy(), t["bucket"].to_numpy(), t["base"]
        based = np.flatnonzero(base.is_valid().to_numpy())
        node = np.arange(len(k))
        if len(based):
            names = np.stack([bucket[based], base.drop_null().to_numpy()], axis=1)
            _, first, back = np.unique(names, axis=0, return_index=True, return_inverse=True)
            node[based] = based[first][back.ravel()]
        root = forest(t.num_rows, node[x], node[y])
        out = np.flatnonzero((root != np.arange(len(k))) & (node == np.arange(len(k))))
        yield pa.record_batch([pa.array(k[out]), pa.array(k[root[out]])], names=["a", "b"])


def _with_candidates(batches):
    """Rows in order of bucket -> (bucket, k) of the sets that have a candidate in the bucket."""
    for t in whole_groups(batches, "bucket"):
        keep = pa.array(np.unique(np.concatenate(_sketch_pairs(t))))
        t = t.select(["bucket", "k"]).take(keep).combine_chunks()
        yield from t.to_batches()


def _shingle_rows(batches):
    """(k, text) -> (k, shingles): texts whose set has the name that was asked for."""
    for b in batches:
        want = b.column("k").to_numpy()
        for i, j, buf, offs in tk.byte_slices(b.column("text"), tk.SMALL_SLICE):
            sh, at = _sets(buf, offs)
            same = np.flatnonzero(_names(sh, at) == want[i:j])
            yield pa.record_batch(
                [pa.array(want[i:j][same]), pa.array([sh[at[d] : at[d + 1]].tobytes() for d in same], pa.binary())], names=["k", "shingles"])


def _overlaps(rows: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of the intersections of the first cut sets with the others (cut 0: of all pairs), by products of slices of their incidence matrix."""
    n = len(rows)
    if n == 2:
        both = float(len(np.intersect1d(*rows, assume_unique=True)))
        return np.full((1, 1) if cut else (2, 2), both)
    who = np.repeat(np.arange(n), [len(r) for r in rows])
    _, col, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1  # only elements of two sets or more
    shared = count[col] > 1
    who, col = who[shared], rank[col[shared]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    total, width = np.zeros((cut or n, n - cut)), 4096
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, (c, c + width))
        m = np.zeros((n, min(width, int(col[-1]) + 1 - c)), np.float32)
        m[who[lo:hi], col[lo:hi] - c] = 1
        total += m[: cut or n] @ m[cut:].T
    return total


def _exact(batches):
    """Rows in order of bucket and side -> (a, b, similarity) of a maximum spanning forest of each bucket, and (a, n): links of each set.

    In a bucket that crosses two blocks each set of the first is compared with each of the second, else all with all.
    n counts the rows that hold a linked set.
    """
    for t in whole_groups(batches, "bucket"):
        bucket, k, sets = t["bucket"].to_numpy(), t["k"].to_numpy(), t["shingles"]
        copies, second = t["copies"].to_numpy(), t["second"].to_numpy(zero_copy_only=False)
        crosses = t["crosses"].to_numpy(zero_copy_only=False)
        ends = np.concatenate([np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        a, b, similarity, linked, count, at = [], [], [], [], [], 0
        for end in ends.tolist():
            own, held = k[at:end], copies[at:end]
            cut = int((~second[at:end]).sum()) if crosses[at] else 0
            if len(own) > 1 and not (crosses[at] and cut in (0, len(own))):
                rows = [np.frombuffer(s, np.uint64) for s in sets.slice(at, end - at).to_pylist()]
                size = np.array([len(r) for r in rows])
                inter = _overlaps(rows, cut)
                union = size[: cut or None, None] + size[None, cut:] - inter
                hit = inter >= THRESHOLD * union - 1e-9
                x, y = np.nonzero(hit if cut else np.triu(hit, 1))
                w = inter[x, y] / union[x, y]
                y += cut
                e = spanning(len(own), x, y, w)
                a.append(own[x[e]])
                b.append(own[y[e]])
                similarity.append(w[e])
                n = np.bincount(x, held[y], len(own)) + np.bincount(y, held[x], len(own))
                some = np.flatnonzero(n)
                linked.append(own[some])
                count.append(n[some].astype(np.int64))
            at = end
        if a:
            a, b, similarity, linked, count = (pa.array(np.concatenate(c)) for c in (a, b, similarity, linked, count))
            none = lambda like, to: pa.nulls(len(like), to)
            yield pa.record_batch([a, b, similarity, none(a, pa.int64())], names=["a", "b", "similarity", "n"])
            yield pa.record_batch([linked, none(linked, pa.int64()), none(linked, pa.float64()), count], names=["a", "b", "similarity", "n"])


def _in_buckets(rows: DataFrame, *then: str) -> DataFrame:
    """Rows in order of bucket, the same sets first in all, so that links of many buckets name the same ones."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", *then, F.xxhash64("k", F.lit(FIRST)))


def _block_tiles(comps: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, k) -> (bucket, k, copies, second, crosses): each block of a component and each two of them are a bucket."""
    rows = comps.select("bucket", "k").join(sets.select("k", "n", "copies"), "k")
    size = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    rows = rows.join(size, "bucket").withColumn("own", F.pmod(F.xxhash64("k", F.lit(FIRST + POOL)), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    own, other = F.col("own"), F.col("other")
    return rows.select(F.xxhash64("bucket", F.least(own, other), F.greatest(own, other)).alias("bucket"), "k", "copies", (own > other).alias("second"), (own != other).alias("crosses"))


def _links(rows: DataFrame, sets: DataFrame, docs: DataFrame, every: bool) -> DataFrame:
    """(a, b, similarity, n): verified links that span every class of sets (n is null); if every link is counted also a's number of linked rows in n (b is null)."""
    leaves, stars = _buckets(sets)
    sketched = leaves.join(sets.select("k", "sig"), "k").select("bucket", "k", "base", "sig")
    comps = components(_in_buckets(sketched).mapInArrow(_sketch_edges, "a long, b long").unionByName(stars), "jaccard-candidates")
    comps = written(comps.select(F.col("id").alias("k"), F.col("root").alias("bucket")), "jaccard-components")
    sizes = comps.groupBy("bucket").agg(F.count("*").alias("size"))
    comps = written(comps.join(sizes, "bucket"), "jaccard-components")
    tiles = comps.where(F.col("size") <= BUCKET).select("bucket", "k")
    large = comps.where(F.col("size") > BUCKET).select("k")
    if every:
        tiles = _block_tiles(comps, sets)
    elif not large.isEmpty():
        tiles = tiles.unionByName(_in_buckets(sketched.join(sent_if_small(large), "k", "left_semi")).mapInArrow(_with_candidates, "bucket long, k long"))
    if not every:
        tiles = tiles.select("bucket", "k", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("second"), F.lit(False).alias("crosses"))
    # a small part of the texts is needed: where their ids fit they go to the texts, else both are shuffled
    wanted = sent_if_small(written(sets.join(comps, "k").select("k", F.col("id").alias("_id")), "jaccard-wanted"))
    text = docs.join(wanted, docs["id"].eqNullSafe(F.col("_id"))).select("k", "text")
    shingles = text.mapInArrow(_shingle_rows, "k long, shingles binary").dropDuplicates(["k"])
    found = _in_buckets(tiles.join(shingles, "k"), "second").mapInArrow(_exact, "a long, b long, similarity double, n long")
    found = written(found if every else found.where("b is not null"), "jaccard-links")
    drop_written(leaves, stars, comps)
    return found


def _joined(docs: DataFrame, id_col: str, text_col: str, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, k, n) of all documents, their different sets (k, id, n, sig, copies), and the links between sets, all of them counted if every."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(docs.mapInArrow(_sketch, "id long, k long, n int, sig array<int>"), "jaccard-rows")
    sets = rows.where("n > 0").groupBy("k").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    sets = written(sets, "jaccard-sets")
    return rows, sets, _links(rows, sets, docs, every)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, similarity): links between different texts, each named by the smallest id that holds its set.

    All have Jaccard similarity THRESHOLD or more. They span every class, so no two linked texts are in
    different classes; of the pairs of a class only those of spanning forests are listed.
    """
    _, sets, found = _joined(docs, id_col, text_col, False)
    name = sets.select("k", "id")
    found = found.join(name.select(F.col("k").alias("a"), F.col("id").alias("first")), "a").join(name.select(F.col("k").alias("b"), F.col("id").alias("second")), "b")
    return found.select(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"), "similarity").distinct()


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, rep_id, linked_id, similarity, n_links, kept.

    n_links is the number of other rows that the row is linked with directly: those with an equal set and those whose
    set has Jaccard similarity THRESHOLD or more with its own.
    class_id is the smallest id that links lead to, kept marks the row with that id. rep_id, the smallest id
    with an equal set, stands for the row's copies in the links; linked_id stands for the most similar other
    set that it has a verified link with, and similarity is theirs; both are null where a set has none. Null
    and empty texts link with nothing and are classes of their own. Rows that repeat an id are treated one by
    one; a null id never names a class that has others. Long texts are taken whole; other columns are ignored;
    an empty table gives no rows.
    """
    return _classes(docs, id_col, text_col, True)


def _classes(docs: DataFrame, id_col: str, text_col: str, every: bool) -> DataFrame:
    """As jaccard_classes(); without n_links unless every link is counted."""
    rows, sets, found = _joined(docs, id_col, text_col, every)
    counts = found.where("b is null").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("others"))
    found = found.where("b is not null").select("a", "b", "similarity")
    classes = components(found.select("a", "b"), "jaccard-classes")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    best = both.groupBy(F.col("a").alias("k")).agg(F.max(F.struct("similarity", F.col("b").alias("other"))).alias("best"))
    best = best.select("k", "best.similarity", F.col("best.other").alias("other"))
    name = sets.select("k", "id", "copies")
    best = best.join(name.select(F.col("k").alias("other"), F.col("id").alias("linked_id")), "other").drop("other")
    if every:
        name = name.join(counts, "k", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1).drop("others")
    more = ["n_links"] if every else []
    per = name.join(best, "k", "left").join(classes.select(F.col("id").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    first = per.groupBy("root").agg(F.min("id").alias("class_id"))
    per = per.join(first, "root").select("k", "class_id", F.col("id").alias("rep_id"), "linked_id", "similarity", *more)
    out = rows.where("n > 0").select("id", "k").join(per, "k").drop("k")
    none = F.lit(None)
    out = out.unionByName(rows.where("n = 0").select(
        "id", F.col("id").alias("class_id"), F.col("id").alias("rep_id"), none.cast("long").alias("linked_id"), none.cast("double").alias("similarity"), *[F.lit(0).cast("long").alias(c) for c in more]))
    return out.select(F.col("id").alias(id_col), "class_id", "rep_id", "linked_id", "similarity", *more, F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each class the one with the smallest id; all rows of an id that stays."""
    [name] = free_names(docs, "_gone")
    gone = _classes(docs, id_col, text_col, False).groupBy(id_col).agg(F.bool_or("kept").alias("_any")).where("not _any").select(F.col(id_col).alias(name))
    return docs.join(sent_if_small(written(gone, "jaccard-gone")), F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
