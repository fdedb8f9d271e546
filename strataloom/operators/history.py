"""The rolling history of each source: the last periods, upserts, repairs, missing periods, contract checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = 365


def recent_periods(current: int | Column, n: int) -> Column:
    """The n periods up to the current one, newest first, on the cycle 1..365."""
    current = F.lit(current) if isinstance(current, int) else current
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.pmod(current - 1 - k, F.lit(PERIODS)) + 1)


def first_per_period(rows: DataFrame, keys: Sequence[str], period: str, order: str, value: str) -> DataFrame:
    """(keys, period, value): the first row of each period."""
    return rows.groupBy(*keys, period).agg(F.min_by(value, order).alias(value))


def fingerprint(history: DataFrame, keys: Sequence[str], period: str, value: str, issues: Sequence[int]) -> DataFrame:
    """Per source the values of the issues in their order, joined, and how many there are."""
    at = F.array_position(F.array(*[F.lit(i) for i in issues]), F.col(period))
    kept = history.where(F.col(period).isin(*issues))
    ordered = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(value).alias("v"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), "|").alias("fingerprint"), F.count("*").alias("n"))


def missing_periods(rows: DataFrame, keys: Sequence[str], period: str, issues: Sequence[int]) -> DataFrame:
    """(keys, missing): every issue that a source has no row for."""
    have = rows.groupBy(*keys).agg(F.collect_set(F.col(period).cast("int")).alias("have"))
    return have.select(*keys, F.explode(F.array_except(F.array(*[F.lit(i) for i in issues]), "have")).alias("missing"))


def rolling_update(history: DataFrame, batch: DataFrame, keys: Sequence[str], period: str, value: str, failed: Column,
                   issues: Sequence[int] | None = None) -> DataFrame:
    """History after a batch: good rows replace their period, failed rows delete it, other periods stay.

    With issues, periods outside them are dropped. batch has one row per source and period.
    """
    keep = history.join(batch.select(*keys, period), [*keys, period], "left_anti")
    out = keep.select(*keys, period, value).unionByName(batch.where(~failed).select(*keys, period, value))
    return out if issues is None else out.where(F.col(period).isin(*issues))


def repair(history: DataFrame, batch: DataFrame, keys: Sequence[str], period: str, value: str, failed: Column) -> DataFrame:
    """History after a repair: only good rows of the batch touch it."""
    return rolling_update(history, batch.where(~failed), keys, period, value, F.lit(False))


def duplicate_keys(rows: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Violations: (rule, n), n the number of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")


def orphans(child: DataFrame, parent: DataFrame, on: Column, rule: str) -> DataFrame:
    return child.join(parent, on, "left_anti").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")


def breaches(rows: DataFrame, condition: Column, rule: str) -> DataFrame:
    return rows.agg(F.count_if(condition).alias("n")).select(F.lit(rule).alias("rule"), "n")


#: The stored history: one row per source, in order, with its rows of the window.
ENTRY_ROW = "struct<at:int,period:int,value:string,position:long,article_id:string>"
ENTRIES = f"source string, ord int, rows array<{ENTRY_ROW}>, fingerprint string, status string, error string"


class Refused(ValueError):
    """An update that does not fit what is stored; rule names why."""

    def __init__(self, rule: str, detail: str = ""):
        super().__init__(f"{rule} {detail}".strip())
        self.rule = rule


def _issues(current: int, size: int) -> list[int]:
    if not 1 <= current <= PERIODS:
        raise Refused("period_out_of_range", str(current))
    return [(current - k - 1) % PERIODS + 1 for k in range(size)]


def _placed(rows: Column, issues: Sequence[int]) -> Column:
    """Rows of the window alone, each with its place in it, in order."""
    at = lambda r: F.array_position(F.array(*map(F.lit, issues)), r["period"]).cast("int")
    fields = ("period", "value", "position", "article_id")
    return F.array_sort(F.filter(F.transform(rows, lambda r: F.struct(at(r).alias("at"), *[r[f].alias(f) for f in fields])), lambda r: r["at"] > 0))


def _entry(source: Column, order: Column, rows: Column, status: Column, error: Column) -> list[Column]:
    return [source.alias("source"), order.cast("int").alias("ord"), rows.cast(f"array<{ENTRY_ROW}>").alias("rows"), F.array_join(F.transform(rows, lambda r: r["value"]), "").alias("fingerprint"), status.alias("status"), error.alias("error")]


def identity_breaches(stored: DataFrame, results: DataFrame) -> DataFrame:
    """(source, rule): sources that are missing from the results, extra, at another place, or there twice."""
    n = F.count("*").alias("n")
    a, b = (t.groupBy("source").agg(F.min("ord").alias(o), n.alias(f"n{o}")) for t, o in ((stored, "_a"), (results, "_b")))
    rule = (
        F.when(F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))) > 1, "repeated").when(F.col("_b").isNull(), "missing")
        .when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "moved"))
    return a.join(b, "source", "full").select("source", rule.alias("rule")).where("rule is not null")


def _refuse(breaches_: DataFrame) -> None:
    first = breaches_.orderBy("source").first()  # one row: the refusal names it
    if first is not None:
        raise Refused(first["rule"], str(first["source"]))


def full_update(stored: DataFrame | None, results: DataFrame, current: int, size: int = 10) -> DataFrame:
    """ENTRIES after a run of one period over all sources.

    results: source, ord, ok, period, value, position, article_id, error. The window becomes that of the current period.
    A good result replaces its period's row, a failed one deletes it; both set status and error anew. What leaves the
    window goes. Refused unless the results are the stored sources in their order, each once, and good ones are of the
    current period with a place: nothing is written then. A first update stores the sources as they come.
    """
    issues = _issues(current, size)
    if stored is not None:
        _refuse(identity_breaches(stored, results))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    odd = F.when(ok & (F.coalesce("period", F.lit(0)) != current), "other_period").when(ok & ~F.coalesce(F.col("position") >= 0, F.lit(False)), "no_place")
    _refuse(results.select("source", odd.alias("rule")).where("rule is not null"))
    own = F.array(F.struct(F.lit(0).alias("at"), F.lit(current).alias("period"), "value", F.col("position").cast("long").alias("position"), F.col("article_id").alias("article_id"))).cast(f"array<{ENTRY_ROW}>")
    none = F.array().cast(f"array<{ENTRY_ROW}>")
    old = results.join(stored.select("source", F.col("rows").alias("_rows")), "source") if stored is not None else results.withColumn("_rows", none)
    kept = F.filter("_rows", lambda r: r["period"] != current)
    rows = _placed(F.concat(kept, F.when(ok, own).otherwise(none)), issues)
    return old.select(*_entry(F.col("source").cast("string"), F.col("ord"), rows, F.when(ok, "ok").otherwise("failed"), F.when(F.coalesce("error", F.lit("")) != "", F.col("error"))))


def full_repair(stored: DataFrame, results: DataFrame, period: int, current: int, size: int = 10) -> DataFrame:
    """ENTRIES after good results for one period of some sources; all else stays, failed results touch nothing.

    A period outside the stored window of the current period moves the window to it, and rows outside go. A repaired
    source loses its status of failure and its error. Refused if a good result has another period, no place, no valid
    row, or a source that is not stored or repeated.
    """
    from strataloom.operators.period import is_value

    issues = _issues(current, size)
    if period not in issues:
        issues = _issues(period, size)
    good = results.where(F.coalesce(F.col("ok"), F.lit(False)))
    odd = F.when(F.coalesce("period", F.lit(0)) != period, "other_period").when(~F.coalesce(F.col("position") >= 0, F.lit(False)), "no_place").when(~is_value(F.col("value")), "no_value")
    _refuse(good.select("source", odd.alias("rule")).where("rule is not null"))
    _refuse(identity_breaches(stored, good.join(stored.select("source", F.col("ord").alias("_o")), "source", "left").withColumn("ord", F.coalesce("_o", "ord"))).where("rule in ('extra', 'repeated')"))
    own = F.array(F.struct(F.lit(0).alias("at"), F.lit(period).alias("period"), "value", F.col("position").cast("long").alias("position"), F.col("article_id").alias("article_id"))).cast(f"array<{ENTRY_ROW}>")
    new = good.select("source", own.alias("_new"))
    both = stored.join(new, "source", "left")
    touched = F.col("_new").isNotNull()
    rows = _placed(F.when(touched, F.concat(F.filter("rows", lambda r: r["period"] != period), F.col("_new"))).otherwise(F.col("rows")), issues)
    return both.select(*_entry(F.col("source"), F.col("ord"), rows, F.when(touched, "ok").otherwise(F.col("status")), F.when(~touched, F.col("error"))))
