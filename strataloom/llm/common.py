"""What the operators of this subpackage share: the shared work folder, written stages, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where a session on one machine names none (tests) a temporary folder is set as checkpoint folder; on a cluster
    that is an error, as its machines do not share one.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strataloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As written(), in so many buckets by a key: a join on the key moves only its other side, or none that is in as many."""
    path = fresh_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    found = df.sparkSession.table(table)
    df.sparkSession.sql(f"DROP TABLE {table}")  # its name alone: the files stay
    return found


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with marks behind them where df has such columns already, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by written(), once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: A side of at most so many rows of a few numbers, some 32 MB, may be sent to every executor.
BROADCAST_ROWS = 1_000_000


def sent_if_small(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, with a broadcast hint if its row count allows; else it is shuffled."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


#: A side of wide rows may be sent if all its bytes are at most so many.
BROADCAST_BYTES = 64 << 20


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    edges: (a long, b long), a != b, in any direction, repeats allowed. Returns (id long, root long) for
    every id that has an edge; root is the smallest id of its component. Each step is one or two
    group-bys whose map side combines first, so a hub with very many neighbours is no single group: the
    minimum per node is an aggregate and is joined back.
    """
    cur = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    before = _signature(cur)
    while True:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour (or itself)
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the smaller neighbours and the node itself go to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        nxt = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        nxt = written(nxt, name)
        after = _signature(nxt)
        drop_written(cur)
        cur = nxt
        if before == after:
            break
        before = after
    ids = cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return ids.unionByName(roots).groupBy("id").agg(F.min("root").alias("root"))


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def vector_sum(df: DataFrame, part, size: int, blocks: int = 32):
    """Sum of one float64 vector of a fixed size per task, reduced on the executors block by block.

    part maps an iterator of Arrow batches to one numpy vector; only the sum, of fixed size, comes to the
    driver. Partial sums are added in the order of their partitions, so reruns over the same files agree.
    """
    from pyspark import TaskContext

    def parts(batches):
        v = part(batches)
        if v is not None:
            yield TaskContext.get().partitionId(), 1.0, v

    return scaled_sum(df, parts, size, blocks)


def scaled_sum(df: DataFrame, parts, size: int, blocks: int = 32):
    """Sum of vectors of a fixed size times their scales, as vector_sum() has it.

    parts maps an iterator of Arrow batches to any number of (place, scale, vector), vectors of float32 or float64; they
    are sent as they are, scaled where they are added in float64, in the order of their places.
    """
    import numpy as np
    import pyarrow as pa

    step = -(-size // blocks)

    def emit(batches):
        for at, scale, v in parts(batches):
            cut = [v[i : i + step].tobytes() for i in range(0, size, step)]
            yield pa.record_batch(
                [pa.array(range(len(cut)), pa.int32()), pa.array([at] * len(cut), pa.int32()), pa.array([scale] * len(cut), pa.float64()),
                 pa.array([v.itemsize] * len(cut), pa.int32()), pa.array(cut, pa.binary())], names=["block", "at", "scale", "width", "v"])

    def add(t: pa.Table) -> pa.Table:
        order = np.argsort(t["at"].to_numpy())
        scales, widths, parts = t["scale"].to_numpy(), t["width"].to_numpy(), t["v"].to_pylist()
        total = np.zeros(len(parts[0]) // widths[0])
        for i in order:
            total += np.frombuffer(parts[i], f"f{widths[i]}").astype(np.float64) * scales[i]
        return pa.table({"block": t["block"][:1], "v": pa.array([total.tobytes()], pa.binary())})

    rows = df.mapInArrow(emit, "block int, at int, scale double, width int, v binary").groupBy("block").applyInArrow(add, "block int, v binary").collect()
    out = np.zeros(size)
    for r in rows:
        v = np.frombuffer(r["v"])
        out[r["block"] * step : r["block"] * step + len(v)] = v
    return out


def forest(n: int, x, y):
    """For n nodes and edges x[i] - y[i]: for each node the smallest node of its component (numpy)."""
    import numpy as np

    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        nxt = label.copy()
        np.minimum.at(nxt, x, low)
        np.minimum.at(nxt, y, low)
        np.minimum.at(nxt, label[x], low)
        np.minimum.at(nxt, label[y], low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            break
        label = nxt
    return label


def spanning(n: int, x, y, weight):
    """For n nodes and edges x[i] - y[i]: the numbers of the edges of a maximum spanning forest (numpy)."""
    import numpy as np

    label, chosen = np.arange(n), [np.zeros(0, np.int64)]
    order = np.argsort(-weight, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    while True:
        cross = np.flatnonzero(label[x] != label[y])
        if not len(cross):
            return np.concatenate(chosen)
        best = np.full(n, len(order))  # of each part the best edge that leaves it
        np.minimum.at(best, label[x[cross]], rank[cross])
        np.minimum.at(best, label[y[cross]], rank[cross])
        e = order[np.unique(best[best < len(order)])]
        chosen.append(e)
        label = forest(n, label[x[e]], label[y[e]])[label]


def whole_groups(batches, key: str, most: int = 8 << 20):
    """Arrow batches in order of a key -> tables of whole groups, of about so many bytes unless a group has more."""
    import numpy as np
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.nbytes
        if n >= most and held[0].column(key)[0] != b.column(key)[b.num_rows - 1]:
            t = pa.Table.from_batches(held)
            values = t[key].to_numpy()
            cut = int(np.searchsorted(values, values[-1]))
            yield t.slice(0, cut)
            rest = t.slice(cut).combine_chunks()
            held, n = rest.to_batches(), rest.nbytes
    if held:
        yield pa.Table.from_batches(held)
