"""The queries for periods: documents, their windows, one verdict per source, several periods, history, retry.

rows: (source, document, pick, position, period, value, record_id), a document being one place that a source's rows
were read from. Failures are statuses; a conflict is never settled by taking one of the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.operators import history, selection
from strataloom.schema import SYMBOLS

DOCUMENT = ["source", "document", "pick"]


def is_value(value: Column) -> Column:
    """Whether a value is two different symbols of the alphabet."""
    return F.coalesce(tx.without_separators(value).rlike(f"^(?!(.)\\1)[{SYMBOLS}]{{2}}$"), F.lit(False))


def is_selected(period: Column, requested: Column, value: Column, position: Column) -> Column:
    """Whether a selected row is one: the period asked for, a value, a place."""
    return F.coalesce((period == requested) & is_value(value) & (position >= 0), F.lit(False))


def for_periods(rows: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Every row once for each requested period: one read of the documents serves all periods."""
    return rows.withColumn("requested", F.explode(F.array(*map(F.lit, dict.fromkeys(periods)))))


def by_document(rows: DataFrame) -> DataFrame:
    """(source, document, pick, requested, status, value, position, window_index, record_id): the choice of each document.

    rows have the column requested. Neighbours of one period and value are one row. window_index is the place of the
    chosen row in its window, -1 if none is chosen.
    """
    keys = [*DOCUMENT, "requested"]
    top = F.col("pick") == "top"
    merged = selection.adjacent_runs(rows, keys, "position", ["period", "value", "record_id"])
    merged = merged.withColumn("position", F.when(top, F.col("first_position")).otherwise(F.col("last_position")))
    # one window for both directions, and one aggregate: the row at its start is the newest end
    inward = F.when(top, F.col("position")).otherwise(-F.col("position"))
    window = merged.withColumn("slot", F.row_number().over(W.partitionBy(*keys).orderBy(inward))).where(F.col("slot") <= selection.WINDOW)
    mine = F.col("period") == F.col("requested")
    found = window.groupBy(*keys).agg(
        F.min_by("period", "slot").alias("_edge"), F.count_distinct(F.when(mine, F.struct("value", "position"))).alias("signatures"),
        F.min(F.when(mine, F.struct("slot", "value", "position", "record_id", (F.col("slot") - 1).alias("window_index")))).alias("r"))
    distance = F.abs(selection.period_step(F.col("_edge"), F.col("requested")))
    status = (
        F.when(distance > selection.MAX_EDGE_DISTANCE, "out_of_reach").when(F.col("signatures") == 0, "not_found").when(F.col("signatures") > 1, "conflict")
        .when(~is_selected(F.col("requested"), F.col("requested"), F.col("r.value"), F.col("r.position")), "invalid").otherwise("ok"))
    ok = F.col("status") == "ok"
    return found.withColumn("status", status).select(
        *keys, "status", *[F.when(ok, F.col(f"r.{c}")).alias(c) for c in ("value", "position", "record_id")],
        F.when(ok, F.col("r.window_index")).otherwise(-1).cast("int").alias("window_index"))


def has_target(rows: DataFrame) -> DataFrame:
    """(source, requested, found): whether a document of a source has the period, a contradiction counting as having it."""
    return by_document(rows).groupBy("source", "requested").agg(F.bool_or(F.col("status").isin("ok", "conflict")).alias("found"))


def by_source(rows: DataFrame, sources: DataFrame, requested: Sequence[int] | None = None) -> DataFrame:
    """(source, requested, status, value, position, carrier, n_documents, n_ok, records): one verdict per source and period.

    conflict: a document contradicts itself, documents contradict each other, or their rows name several records. ok:
    the value of all documents that have one, its carrier being the first of them. Otherwise the mildest failure of a
    document, or no_rows for a source without one. records: the different records named, in order. Without the list of
    requested periods it is found in the rows, which are then read once more.
    """
    chosen = by_document(rows)
    ok = F.col("status") == "ok"
    rank = F.when(F.col("status") == "not_found", 1).when(F.col("status") == "out_of_reach", 2).otherwise(3)
    got = chosen.groupBy("source", "requested").agg(
        F.count("*").alias("n_documents"), F.count_if(ok).alias("n_ok"), F.count_distinct(F.when(ok, F.col("value"))).alias("_values"),
        F.bool_or(F.col("status") == "conflict").alias("_conflict"), F.min_by("status", rank).alias("_failure"),
        F.min(F.when(ok, F.struct("document", "value", "position"))).alias("_carrier"),
        F.array_sort(F.collect_set(F.when(ok & (F.col("record_id") != ""), F.col("record_id")))).alias("records"))
    status = F.when(F.col("_conflict") | (F.col("_values") > 1) | (F.size("records") > 1), "conflict").when(F.col("n_ok") > 0, "ok").otherwise(F.col("_failure"))
    asked = [r[0] for r in rows.select("requested").distinct().collect()] if requested is None else requested  # a few
    every = sources.select("source").withColumn("requested", F.explode(F.array(*map(F.lit, dict.fromkeys(asked)))) if asked else F.explode(F.array().cast("array<int>")))
    out = every.join(got.withColumn("status", status), ["source", "requested"], "left")
    good = F.col("status") == "ok"
    return out.select(
        "source", "requested", F.coalesce("status", F.lit("no_rows")).alias("status"), F.when(good, F.col("_carrier.value")).alias("value"),
        F.when(good, F.col("_carrier.position")).alias("position"), F.when(good, F.col("_carrier.document")).alias("carrier"),
        F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"), F.coalesce("n_ok", F.lit(0)).cast("long").alias("n_ok"),
        F.coalesce("records", F.array().cast("array<string>")).alias("records"))


def failed_everywhere(results: DataFrame) -> DataFrame:
    """(source, reasons): sources that have failed for every requested period, with the periods and reasons in order."""
    reason = F.concat_ws(":", F.lpad(F.col("requested").cast("string"), 3, "0"), "status")
    got = results.groupBy("source").agg(F.bool_and(F.col("status") != "ok").alias("_failed"), F.array_sort(F.collect_list(F.struct("requested", reason.alias("t")))).alias("l"))
    return got.where("_failed").select("source", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("reasons"))


def rebuilt_history(rows: DataFrame, keys: Sequence[str], current: int, size: int = 10) -> DataFrame:
    """(keys, status, n, values, missing): the history of each source made anew from its rows.

    Of each of the last periods the first row counts; a period with several values makes the source a conflict
    without values, a period without a row makes it incomplete with those that it has.
    """
    issues = [(current - k - 1) % 365 + 1 for k in range(size)]
    own = rows.where(F.col("period").isin(*issues))
    per = own.groupBy(*keys, "period").agg(F.count_distinct("value").alias("_values"), F.min_by("value", "position").alias("value"))
    at = F.array_position(F.array(*map(F.lit, issues)), F.col("period"))
    got = per.groupBy(*keys).agg(F.max("_values").alias("_most"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(at.alias("at"), "value"))).alias("l"), F.collect_set("period").alias("have"))
    missing = F.array_except(F.array(*map(F.lit, issues)), F.col("have"))
    status = F.when(F.col("_most") > 1, "conflict").when(F.col("n") < size, "incomplete").otherwise("ok")
    return got.select(*keys, status.alias("status"), F.col("n").cast("long").alias("n"), F.when(status != "conflict", F.array_join(F.transform("l", lambda x: x["value"]), "|")).alias("values"),
                      F.array_join(missing.cast("array<string>"), ",").alias("missing"))


def apply_retry(old: DataFrame, repaired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, status): results after a retry of failed sources.

    Repaired rows are taken once per value and position; a source with several, or with another value than it already
    has, is a conflict. Sources that are not repaired keep what they have; new ones are added.
    """
    new = repaired.dropDuplicates([*keys, "value", "position"]).groupBy(*keys).agg(F.count("*").alias("_n"), F.min("value").alias("_new"))
    both = old.select(*keys, F.col("value").alias("_old")).join(new, list(keys), "full")
    status = F.when(F.col("_n") > 1, "conflict").when(F.col("_old").isNotNull() & F.col("_new").isNotNull() & (F.col("_old") != F.col("_new")), "conflict").when(
        F.col("_old").isNull() & F.col("_new").isNotNull(), "repaired").otherwise("kept")
    return both.select(*keys, F.when(status != "conflict", F.coalesce("_old", "_new")).alias("value"), status.alias("status"))


def same_sources(results: DataFrame, stored: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, rule): sources that are missing, extra or at another place in one of two ordered tables."""
    number = lambda t, name: t.select(*keys, F.row_number().over(W.orderBy(order)).alias(name))  # noqa: E731  a table of sources
    both = number(results, "_a").join(number(stored, "_b"), list(keys), "full")
    rule = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "moved")
    return both.select(*keys, rule.alias("rule")).where("rule is not null")


def joined_documents(docs: DataFrame, mark: str) -> DataFrame:
    """(source, url, record_id, text, n): documents of one source and address put together, where there are several and they name one record."""
    got = docs.groupBy("source", "url").agg(
        F.count("*").alias("n"), F.count_distinct("record_id").alias("_records"), F.min("record_id").alias("record_id"), F.array_sort(F.collect_list(F.struct("doc_ord", "text"))).alias("l"))
    return got.where("n > 1 and _records = 1").select("source", "url", "record_id", F.array_join(F.transform("l", lambda x: x["text"]), mark).alias("text"), "n")


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str], failed: Column, current: int) -> DataFrame:
    """The stored history after the batch of one period, on the ten periods up to it."""
    return history.rolling_update(stored, batch, keys, "period", "value", failed, [(current - k - 1) % 365 + 1 for k in range(10)])
