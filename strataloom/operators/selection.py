"""Ordered selection: direction windows, adjacent merging, edge guard, conflicts, status per source.

Rows of a source are ordered by position. A top source has its newest rows first, a bottom source last.
Failures are values of a status column, never exceptions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW = 3
MAX_EDGE_DISTANCE = 3
LAST_PERIOD = 365


def direction_window(rows: DataFrame, keys: Sequence[str], order: str, top: Column | bool = True, size: int = WINDOW) -> DataFrame:
    """The first rows of top sources and the last of bottom sources, with slot 1..size from the newest.

    top must depend on the keys alone. Each direction is a filter of its own, so that the row limit reaches
    below the exchange.
    """
    def side(part: DataFrame, by: Column) -> DataFrame:
        return part.withColumn("slot", F.row_number().over(W.partitionBy(*keys).orderBy(by))).where(F.col("slot") <= size)

    if isinstance(top, bool):
        return side(rows, F.col(order).asc() if top else F.col(order).desc())
    return side(rows.where(top), F.col(order).asc()).unionByName(side(rows.where(~top), F.col(order).desc()))


def adjacent_runs(rows: DataFrame, keys: Sequence[str], order: str, same: Sequence[str]) -> DataFrame:
    """Neighbouring rows with equal same columns as one row: first and last place, number, all places in order."""
    w = W.partitionBy(*keys).orderBy(order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.lag(order).over(w).isNull()
    runs = rows.withColumn("_run", F.sum((first | changed).cast("int")).over(w))
    return runs.groupBy(*keys, "_run", *same).agg(
        F.min(order).alias("first_position"), F.max(order).alias("last_position"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(order)).alias("positions")).drop("_run")


def period_step(before: Column, after: Column) -> Column:
    """after - before, the pair of the last and the first period counting as neighbours; no other wrap."""
    return F.when((before == LAST_PERIOD) & (after == 1), 1).when((before == 1) & (after == LAST_PERIOD), -1).otherwise(after - before)


def edge_distance(rows: DataFrame, keys: Sequence[str], order: str, top: Column, period: str, requested: int) -> DataFrame:
    """Per source the period at its newest end and its distance from the requested one."""
    edges = rows.groupBy(*keys).agg(F.min_by(period, order).alias("_first"), F.max_by(period, order).alias("_last"))
    edge = F.when(top, F.col("_first")).otherwise(F.col("_last"))
    return edges.select(*keys, edge.alias("edge"), F.abs(period_step(edge, F.lit(requested))).alias("distance"))


def selected(rows: DataFrame, keys: Sequence[str], order: str, top: Column, period: str, value: str, requested: int) -> DataFrame:
    """One row per source: the value of the requested period within the direction window, or why there is none.

    status: out_of_reach (the newest end is too far away), not_found (no window row has the period), conflict
    (rows of the period differ in value or position), ok. The representative is the first row of top and the
    last of bottom sources. Rows are expected once per (period, value, position): see adjacent_runs.
    """
    window = direction_window(rows, keys, order, top).where(F.col(period) == requested)
    found = window.groupBy(*keys).agg(
        F.count_distinct(F.struct(value, order)).alias("signatures"), F.count_distinct(value).alias("values"),
        F.min_by(value, "slot").alias("value"), F.min_by(order, "slot").alias("position"))
    edges = edge_distance(rows, keys, order, top, period, requested)
    status = (
        F.when(F.col("distance") > MAX_EDGE_DISTANCE, "out_of_reach").when(F.col("signatures").isNull(), "not_found")
        .when(F.col("signatures") > 1, "conflict").otherwise("ok"))
    ok = F.col("status") == "ok"
    return edges.join(found, list(keys), "left").withColumn("status", status).select(
        *keys, "edge", "status", F.coalesce("signatures", F.lit(0)).cast("long").alias("signatures"),
        F.when(ok, F.col("value")).alias("value"), F.when(ok, F.col("position")).alias("position"))


def conflicts(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Per group the distinct values (which count across documents) and the distinct (value, position) pairs (within one)."""
    return rows.groupBy(*keys).agg(
        F.count_distinct(value).alias("cross_signatures"), F.count_distinct(F.struct(value, order)).alias("local_signatures"))


def first_monotone(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows up to the first that is smaller than the row before it."""
    w = W.partitionBy(*keys).orderBy(order)
    broken = F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False)).cast("int")
    return rows.withColumn("_broken", broken).withColumn("_broken", F.sum("_broken").over(w)).where("_broken = 0").drop("_broken")


def steps(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per group whether every step of the order column is exactly 1."""
    step = F.col(order) - F.lag(order).over(W.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_step", step).groupBy(*keys).agg(
        F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("_step") == 1, F.lit(True))).alias("valid"))


def cycles(rows: DataFrame, keys: Sequence[str], order: str, opens: Column) -> DataFrame:
    """A running number that grows at each row that opens a cycle."""
    return rows.withColumn("cycle", F.sum(opens.cast("int")).over(W.partitionBy(*keys).orderBy(order)))


def conflict_details(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """(keys, kind, details) of groups whose rows contradict each other, each candidate as value@place, in order of place and value.

    kind: values (different values) or places (one value at several places). Rows that repeat are told once.
    """
    told = F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    got = rows.groupBy(*keys).agg(F.count_distinct(value).alias("_values"), told.alias("_l")).where(F.size("_l") > 1)
    text = F.array_join(F.transform("_l", lambda x: F.concat(x["v"], F.lit("@"), x["o"].cast("string"))), ",")
    return got.select(*keys, F.when(F.col("_values") > 1, "values").otherwise("places").alias("kind"), text.alias("details"))
