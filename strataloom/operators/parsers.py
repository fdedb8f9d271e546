"""Parser classes as plans: slices, chunks, complements, posts and linked pairs before a row pattern.

A parser is a table function from documents to candidates. Its class fixes the plan; its words and patterns
are parameters, so that sources of one class share one plan over one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.operators.extraction import candidates, java_pattern
from strataloom.operators.selection import period_step
from strataloom.schema import SYMBOLS


def _place(text: Column, pattern: str) -> Column:
    """The code-point offset of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.char_length(F.element_at(F.split(text, pattern, 2), 1)))


def slice_of(text: Column, start: str = "", stop: str = "", inclusive: bool = False, stop_needed: bool = False) -> Column:
    """struct<text, start> of the part from the first start to the first stop after it; null where a mark is missing.

    inclusive: the start mark itself belongs to the part. A stop that is not needed and not there is the end.
    """
    found = F.regexp_extract(text, f"({start})", 1) if start else F.lit("")
    at = _place(text, start) if start else F.lit(0)
    begin = at if inclusive else at + F.char_length(found)
    tail = F.substring(text, begin + 1, F.char_length(text))
    if not stop:
        return F.when(at.isNotNull(), F.struct(tail.alias("text"), begin.alias("start")))
    searched = F.substring(text, at + F.char_length(found) + 1, F.char_length(text))
    length = _place(searched, stop) + (F.char_length(found) if inclusive else F.lit(0))
    part = F.coalesce(F.substring(tail, F.lit(1), length), tail)
    good = at.isNotNull() & (length.isNotNull() if stop_needed else F.lit(True))
    return F.when(good, F.struct(part.alias("text"), begin.alias("start")))


def sliced_rows(docs: DataFrame, keys: Sequence[str], text: str, pattern: str | Sequence[str], **marks) -> DataFrame:
    """Candidates of patterns in the slice of every document, positions in the whole text."""
    part = docs.select(*keys, slice_of(F.col(text), **marks).alias("_p")).where("_p is not null").select(*keys, F.col("_p.start").alias("_start"), F.col("_p.text").alias("_text"))
    rows = candidates(part, [*keys, "_start"], "_text", [pattern] if isinstance(pattern, str) else pattern, SYMBOLS)
    return rows.withColumn("position", F.col("position") + F.col("_start")).drop("_start")


def guarded(docs: DataFrame, guards: dict[str, str], text: str, mark: str = "") -> DataFrame:
    """The documents with the given column values whose text holds a mark; others give no rows."""
    for column, value in guards.items():
        docs = docs.where(F.col(column).eqNullSafe(value))
    return docs.where(F.col(text).rlike(mark)) if mark else docs


def chunk_rows(docs: DataFrame, keys: Sequence[str], text: str, heading: str, field: str) -> DataFrame:
    """(keys, position, period, value): of the chunk under each heading the field's value.

    heading has the group period, field the group zodiac; chunks without a valid field give no row.
    """
    head, names = java_pattern(heading)
    own, fields = java_pattern(field)
    marks = tx.matches(F.col(text), head, (0, names["period"]))
    found = docs.select(*keys, F.posexplode(F.arrays_zip(marks.alias("m"), F.slice(F.split(F.col(text), head, -1), 2, F.size(F.split(F.col(text), head, -1))).alias("chunk"))).alias("_k", "_c"))
    value = tx.clean_value(F.regexp_extract("_c.chunk", own, fields["zodiac"]))
    rows = found.select(*keys, F.col("_c.m.offset").alias("position"), F.col("_c.m.g1").try_cast("int").alias("period"), value.alias("value"))
    return rows.where(F.col("value").rlike(f"^[{SYMBOLS}]{{2}}$") & F.col("period").between(1, 365))


def complement_rows(docs: DataFrame, keys: Sequence[str], text: str, pattern: str) -> DataFrame:
    """(keys, position, period, value) of rows that list ten symbols: the two that are missing, in the alphabet's order.

    pattern has the groups period and picks; rows with repeated or too few symbols are no rows.
    """
    java, names = java_pattern(pattern)
    rows = docs.select(*keys, F.explode(tx.matches(F.col(text), java, (names["period"], names["picks"]))).alias("m"))
    picks = F.regexp_extract_all(F.col("m.g1"), F.lit(f"([{SYMBOLS}])"), F.lit(1))
    rows = rows.select(*keys, F.col("m.offset").alias("position"), F.col("m.g0").try_cast("int").alias("period"), picks.alias("picks"))
    good = (F.size("picks") == 10) & (F.size(F.array_distinct("picks")) == 10) & F.col("period").between(1, 365)
    return rows.where(good).withColumn("value", F.array_join(tx.complement(list(SYMBOLS), F.col("picks")), "")).drop("picks")


def primary_post(posts: DataFrame, keys: Sequence[str], wanted: Column) -> DataFrame:
    """Per key the first post that is wanted."""
    rest = [c for c in posts.columns if c not in (*keys, "place")]
    return posts.where(wanted).groupBy(*keys).agg(F.min_by(F.struct("place", *rest), "place").alias("p")).select(*keys, "p.*")


def uncontradicted(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows (keys, period, value, ...) of keys for which no other post gives a shared period another value."""
    other = others.select(*keys, F.col("period").alias("_period"), F.col("value").alias("_value"))
    both = rows.select(*keys, "period", "value").join(other, list(keys)).where("period = _period and value <> _value")
    return rows.join(both.select(*keys).distinct(), list(keys), "left_anti")


def linked_pairs(docs: DataFrame, keys: Sequence[str], text: str, url: str, reference: str, anchor: str) -> DataFrame:
    """(keys, anchor_url, body_url, anchor_text, body_text): documents of one source of which the first holds
    the anchor and names the second by its reference."""
    a = docs.where(F.col(text).rlike(anchor)).select(*keys, F.col(url).alias("anchor_url"), F.col(text).alias("anchor_text"))
    b = docs.where(F.coalesce(F.col(reference), F.lit("")) != "").select(*keys, F.col(url).alias("body_url"), F.col(text).alias("body_text"), F.col(reference).alias("_ref"))
    named = F.contains(F.replace("anchor_text", F.lit("\\/"), F.lit("/")), F.col("_ref"))
    return a.join(b, list(keys)).where((F.col("anchor_url") != F.col("body_url")) & named).drop("_ref")


def first_has_period(rows: DataFrame, keys: Sequence[str], heading: str, allowed: Sequence[int] = (0,)) -> DataFrame:
    """Rows of keys whose first row has the period of the heading, or one that is so many steps from it."""
    first = rows.groupBy(*keys).agg(F.min_by("period", "position").alias("_first"), F.first(heading).alias("_heading"))
    good = first.where(period_step(F.col("_heading"), F.col("_first")).isin(*allowed)).select(*keys)
    return rows.join(good, list(keys), "left_semi")


def stepping(rows: DataFrame, keys: Sequence[str], allowed: Sequence[int], least: int, newest: int | None = None) -> DataFrame:
    """Rows of keys with at least so many rows all of whose steps are allowed; newest: only the last so many count and stay."""
    w = W.partitionBy(*keys)
    if newest is not None:
        back = F.row_number().over(w.orderBy(F.col("position").desc()))
        rows = rows.withColumn("_back", back).where(F.col("_back") <= newest).drop("_back")
    step = period_step(F.lag("period").over(w.orderBy("position")), F.col("period"))
    judged = rows.withColumn("_step", step).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.bool_and(F.coalesce(F.col("_step").isin(*allowed), F.lit(True))).alias("_good"))
    return rows.join(judged.where(F.col("_good") & (F.col("_n") >= least)).select(*keys), list(keys), "left_semi")
