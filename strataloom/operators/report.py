"""Frequency ranking and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dense_ranking(rows: DataFrame, symbol: str, tie: Column) -> DataFrame:
    """(symbol, n, rank, ordinal): dense rank by count, ordinal by count and then the tie order.

    The windows run over one row per symbol, not over the rows.
    """
    counts = rows.groupBy(symbol).agg(F.count("*").alias("n"))
    by = F.col("n").desc()
    return counts.select(
        symbol, "n", F.dense_rank().over(W.orderBy(by)).cast("long").alias("rank"), F.row_number().over(W.orderBy(by, tie)).cast("long").alias("ordinal"))


def symbols(values: DataFrame, value: str, name: str) -> DataFrame:
    """One row per symbol of every value, (value, name) pairs once."""
    return values.select(value, name).distinct().select(F.explode(F.split(value, "")).alias("symbol"))


def report_lines(results: DataFrame, value: str, name: str, order: str, ranking: DataFrame, symbol: str) -> DataFrame:
    """(part, ordinal, line): result lines once per (value, name) at their first place, then the ranking."""
    firsts = results.groupBy(value, name).agg(F.min(order).alias("at"))
    lines = firsts.select(F.lit(0).alias("part"), F.col("at").cast("long").alias("ordinal"), F.concat_ws(" ", value, name).alias("line"))
    tail = ranking.select(F.lit(1).alias("part"), F.col("ordinal").cast("long").alias("ordinal"), F.concat_ws("\t", symbol, "n", "rank").alias("line"))
    return lines.unionByName(tail)


#: The payload whose records carry an article id.
ARTICLES = "admin_article_api"


def record_json(period: Column, value: Column, position: Column, positions: Column, kind: Column, payload: Column, record_id: Column, evidence: Column) -> Column:
    """A record as history files hold it: without places of its own the place alone, evidence if any, the article id of article payloads."""
    own = F.when(F.size(F.coalesce(positions, F.array().cast("array<long>"))) > 0, positions).otherwise(F.array(position.cast("long")))
    some = F.when(F.size(evidence) > 0, evidence)
    article = F.when((payload == ARTICLES) & (record_id != ""), record_id)
    return F.to_json(F.struct(  # fields that are null are left out
        period.alias("period"), value.alias("zodiac"), position.alias("position"), own.alias("source_positions"), kind.alias("position_kind"), some.alias("evidence"), article.alias("article_id")))
