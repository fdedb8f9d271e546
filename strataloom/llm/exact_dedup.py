"""Exact dedup by distributed MSD radix partitioning.

Texts are equal when identical after lower-casing A-Z; null counts as empty. A group of rows that agree so
far is split by the next digit, a run of successive bytes whose width grows eightfold from level to level, up
to WIDEST (the first digit also holds the length in bytes, as texts of different lengths cannot be equal). A group is
finished when it has one row or its texts have ended; equality is decided by the bytes, never by a digest.

Each level is one aggregate on (group, digit), combined on the map side, and one equi-join that hands the
new group back to its rows; a digit that very many rows share is a skewed join, which adaptive execution
splits. Only rows of groups that still have several rows and bytes left go to the next level, with the bytes
that are left, so the text is shuffled once and copies a few times more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import drop_written, free_names, fresh_path, sent_if_small, written

FIRST_DIGIT = 64
GROWTH = 8
WIDEST = 1 << 20


def ascii_lower(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep_id is the largest id of the rows with an equal text. Rows repeated with one id count one by one in
    group_size; of several rows with the id that stays all are marked kept. A null id is never the largest
    unless all are null. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    norm = F.encode(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8")
    rest = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("rest")).select(
        "id", F.sha2("rest", 256).alias("sha"), F.lit(0).cast("long").alias("gid"), "rest",
        F.octet_length("rest").cast("long").alias("len"),
    )
    done, width, level = fresh_path(spark, "radix-done"), FIRST_DIGIT, 0
    while True:
        # the group's number so far and the next digit; the length only splits at the first level
        keyed = rest.withColumn("digit", F.substring("rest", 1, width))
        groups = keyed.groupBy("gid", "len", "digit").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
        groups = written(groups.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        split = keyed.join(groups, ["gid", "len", "digit"]).select(
            "id", "sha", "keep_id", "n", F.col("next").alias("gid"), "len",
            F.expr(f"substring(rest, {width + 1})").alias("rest"),
        )
        split = written(split.withColumn("open", (F.col("n") > 1) & (F.octet_length("rest") > 0)).withColumn(
            "rest", F.when(F.col("open"), F.col("rest"))), "radix-level")
        split.where(~F.col("open")).select("id", "keep_id", "n", "sha").write.mode("append").parquet(done)
        drop_written(groups)
        if level:
            drop_written(previous)
        if split.where("open").isEmpty():
            drop_written(split)
            break
        previous, level, width = split, level + 1, min(width * GROWTH, WIDEST)
        rest = split.where("open").select("id", "sha", "gid", "rest", "len")
    return spark.read.parquet(done).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the largest id; all rows of an id that stays.

    The ids of which no row stays are few: where their count allows they are sent to the texts, else both are
    shuffled. An empty table stays empty; other columns stay as they are.
    """
    [name] = free_names(docs, "_gone")
    gone = exact_groups(docs, id_col, text_col).groupBy(id_col).agg(F.bool_or("kept").alias("_any")).where("not _any").select(F.col(id_col).alias(name))
    return docs.join(sent_if_small(written(gone, "exact-gone")), F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
