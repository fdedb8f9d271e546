"""Compression of vectors to product codes by integer k-means, with exact results from single-precision screening.

Components become integers, floor(SCALE * x), and vectors are cut into PARTS equal parts, each with a codebook of
its own. The nearest entry of every part is found by one float32 matrix product of a block of parts and the
codebook. A dot product of m terms is off by gamma(m + 2) |x| |c| at most, whatever the order of its additions and
with both factors rounded, so every entry has an interval that surely holds its distance. Entries whose interval
reaches below the smallest upper end are evaluated again in int64; of those the least distance wins, then the
lower index.

A round is one pass over a written table: tasks send the sums of what they have assigned, one row for each entry
and component, which are added by a group-by. Only codebooks, of a size fixed by the parameters, reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import sent_if_small, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors are compared in blocks of so many, entries are evaluated again in slices of so many.
BLOCK, AGAIN = 4096, 1 << 16
#: Larger integers are refused in any case.
BEYOND = 2.0**62
#: Half a unit in the last place of 1.0 in single precision.
UNIT = 2.0**-24


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x (int64) the index of the nearest row of book (int64) and the squared distance, exactly."""
    m = x.shape[1]
    gamma = (m + 2) * UNIT / (1 - (m + 2) * UNIT)
    with np.errstate(over="ignore", invalid="ignore"):
        dots = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
        x_norm, book_norm = (np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) for v in (x, book))
        # distances without |x|, which is the same for all entries; the last term is for the rounding of this in double
        score = book_norm**2 - 2 * dots
        off = (2 * gamma * (1 + 1e-9)) * np.outer(x_norm, book_norm) + 1e-13 * (book_norm**2 + 2 * np.abs(dots))
        row, entry = np.nonzero(~(score - off > (score + off).min(axis=1, keepdims=True)))
    far = np.concatenate([((x[row[i : i + AGAIN]] - book[entry[i : i + AGAIN]]) ** 2).sum(axis=1) for i in range(0, len(row), AGAIN)])
    order = np.lexsort((entry, far, row))
    first = order[np.searchsorted(row[order], np.arange(len(x)))]
    return entry[first], far[first]


def _blocks(batches, dim: int):
    """Arrow batches with a column v of lists of dim integers -> (batch, first row, matrix) in blocks."""
    for b in batches:
        flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, dim)
        for i in range(0, b.num_rows, BLOCK):
            yield b, i, flat[i : i + BLOCK]


def _sums(books: np.ndarray):
    """Vectors -> (slot, total): for each part and entry the sums of its parts' components, and their number."""
    parts, entries, width = books.shape

    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for _, _, v in _blocks(batches, parts * width):
            for p in range(parts):
                x = v[:, p * width : (p + 1) * width]
                at, _ = nearest(x, books[p])
                np.add.at(total[p], at, np.column_stack([x, np.ones(len(x), np.int64)]))
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int64)), pa.array(total.ravel()[used])], names=["slot", "total"])

    return run


def _codes(books: np.ndarray):
    """Vectors -> (id, label, code, error)."""
    parts, _, width = books.shape
    hexes = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def run(batches):
        for b, i, v in _blocks(batches, parts * width):
            error, code = np.zeros(len(v), np.int64), np.array([""] * len(v))
            for p in range(parts):
                at, far = nearest(v[:, p * width : (p + 1) * width], books[p])
                error, code = error + far, np.char.add(code, hexes[at])
            own = b.slice(i, len(v))
            yield pa.record_batch([own.column("id"), own.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def trained(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks, int64 of shape (parts, entries, width), after some rounds over a written table with a column v."""
    for _ in range(rounds):
        found = rows.select("v").mapInArrow(_sums(books), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
        total = np.zeros((books.shape[0], books.shape[1], books.shape[2] + 1), np.int64)
        total.ravel()[found["slot"].to_numpy()] = found["total"].to_numpy()
        count = total[:, :, -1:]
        books = np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, code, error, label_error, codebooks_sha256) of each usable vector, and the codebooks.

    Rows whose vector is null or has null or non-finite components are dropped. The vector of the smallest id sets
    the length; vectors of another length, and all where no vector has an id, have a null code and error. An id that
    repeats counts once among the first ENTRIES; of its vectors the componentwise smallest is taken. Rows without an
    id take part but are no first entries. Lengths that parts do not divide, and components too large for squared
    distances in 64 bits, raise a ValueError. Errors of a null label are summed together. Other columns are ignored;
    an empty table gives an empty one.
    """
    v = F.col(vector_col)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(usable).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
        F.transform(v, lambda x: F.floor(F.greatest(F.lit(-BEYOND), F.least(F.lit(BEYOND), x.cast("double") * SCALE)))).alias("v"))
    rows = written(rows, "codes-vectors")
    ids = rows.where("id is not null").select("id").distinct().orderBy("id").limit(ENTRIES)  # 256 rows at most
    seeds = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    dim = len(seeds[0]["v"]) if seeds else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    fit = F.size("v") == dim if dim else F.lit(False)
    largest = rows.where(fit).agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("x")).first()["x"] or 0
    if dim * (2 * largest + 1) ** 2 >= 1 << 63:
        raise ValueError("components are too large for squared distances in 64 bits")
    books = np.array(first := [r["v"] for r in seeds if len(r["v"]) == dim], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    books = trained(rows.where(fit), books, rounds) if dim else books
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kind = rows.schema["label"].dataType.simpleString()
    made = rows.where(fit).mapInArrow(_codes(books), f"id long, label {kind}, code string, error long") if dim else rows.where("false").select(
        "id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    odd = rows.where(~fit).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    made = written(made.unionByName(odd), "codes-made")
    sums = written(made.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    out = made.join(sent_if_small(sums.withColumnRenamed("label", "_label")), F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books


def decoded(codes: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """codes with a column vector: what each code stands for, in the scale of the vectors. A null code has none."""
    parts, _, width = books.shape
    table = (books / SCALE).tolist()  # of a size fixed by the parameters
    entry = [F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    lists = [F.array(*[F.array(*map(F.lit, e)) for e in table[p]]) for p in range(parts)]
    return codes.withColumn("vector", F.concat(*[F.get(lists[p], entry[p]) for p in range(parts)]))
