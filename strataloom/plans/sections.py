"""Queries over configured blocks: a user's events as the rows of a page of one of the five block parsers, and read back.

The parser follows from the user's number, and so does what the page is like: as it should be, with its heading twice,
without the mark that its source's stop asks for, or with mentions of the heading but none. The SQL twin tells which rows
or which failure each must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.operators import blocks, extraction, registry
from strataloom.schema import SYMBOLS

PARSERS = ("site_scoped_two_zodiac", "named_block", "generic_two_zodiac", "new_topic_235_exact", "yiyechunfeng_bottom")
GOOD, TWICE, NO_STOP, LOOSE = range(4)
RECORD = rf"(?P<period>\d{{3}})\s*期\s*[：]?\s*(?:绝)?杀二肖【(?P<zodiac>[{SYMBOLS}]{{2}})】开(?P<open>\d\d)"
LONG = "甲栏目很好 甲栏目更好，看下面这些很长很长的说明文字，一直写到四十个字以上为止，这样就不是标题了，对吧<br>甲栏目 "


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, nth, period, value, result) of all events, the periods going down from 365.

    Events are few bytes for the work on the pages made of them, so partitions are not joined by their size.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    e = e.select("user_id", F.posexplode("l").alias("nth", "event_id"))
    symbol = lambda k: F.substring(F.lit(SYMBOLS), (k + 1).cast("int"), F.lit(1))
    a = F.col("user_id") % 12
    return e.select(
        "user_id", "nth", (365 - F.col("nth") % 365).alias("period"), F.concat(symbol(a), symbol((a + 1 + F.col("event_id") % 11) % 12)).alias("value"),
        F.lpad((F.col("event_id") % 49 + 1).cast("string"), 2, "0").alias("result"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    kind, like = u % 5, F.floor(u / 5) % 4
    per = rows(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("nth", "period", "value", "result"))).alias("l"))
    number = lambda r: F.lpad(r["period"].cast("string"), 3, "0")
    lines = lambda one, between: F.array_join(F.transform("l", one), between)
    plain = lines(lambda r: F.concat(F.lit("<p>"), number(r), F.lit("期：杀二肖【"), r["value"], F.lit("】开"), r["result"], F.lit("</p>")), "")
    loose = F.concat(F.lit(LONG), lines(lambda r: F.concat(number(r), F.lit("期 绝杀二肖【"), r["value"], F.lit("】开"), r["result"]), "<br>"))
    normal = F.concat(F.lit("<h3>甲栏目</h3>"), plain, F.lit("<h3>乙栏目</h3><p>003期：杀二肖【狗猪】开55</p>"), F.when(like == TWICE, F.lit("<h3>甲栏目</h3>")).otherwise(""))
    night = F.concat(
        F.lit("<p>【码友一夜春风】</p>"), lines(lambda r: F.concat(number(r), F.lit("期杀"), r["value"], F.lit("√")), " "), F.when(like == NO_STOP, F.lit("")).otherwise(F.lit("<p>【码友书阳】</p>")),
        F.lit("003期杀狗猪"), F.when(like == TWICE, F.lit("<p>【码友一夜春风】</p>")).otherwise(""))
    fixed, topic = kind == 4, kind == 3
    name, pick, url, _ = blocks.NIGHT_WIND
    topic_name = "杯中之水"
    at = lambda values: F.get(F.array(*map(F.lit, values)), kind.cast("int"))
    return per.select(
        u.alias("source_id"), at(PARSERS).alias("parser"), F.when(fixed, name).when(topic, topic_name).otherwise("甲栏目").alias("name"), F.when(fixed, pick).otherwise("top").alias("pick"),
        F.when(fixed, url).when(topic, blocks.TOPIC_SOURCES[topic_name][1]).otherwise("https://a.example/").alias("url"), F.lit("page_and_scripts").alias("payload"),
        F.when(fixed, "【码友一夜春风】").otherwise("甲栏目").alias("title"), F.when(kind == 1, RECORD).otherwise("").alias("record"),
        F.when(fixed, "【码友书阳】").when(like == NO_STOP, "没有这个").otherwise("").alias("stop"), F.lit("").alias("linked_document_pattern"), (F.floor(u / 20) % 2 == 1).alias("strict_block"),
        F.when(fixed, night).when(like == LOOSE, loose).otherwise(normal).alias("source"))


def registry_blocks(spark, sf_dir):
    found = registry.placed(blocks.parse_blocks(pages(spark, sf_dir), ["source_id"]))
    return found.select("source_id", "parser", "status", F.explode_outer("rows").alias("r")).select("source_id", "parser", "status", "r.period", "r.value", "r.open_result")


def bank_union_full(spark, sf_dir):
    """The whole bank of recognisers over the visible text of all pages of its kind of row, whatever their parser."""
    p = pages(spark, sf_dir).where("parser <> 'yiyechunfeng_bottom'")
    found = p.select("source_id", F.explode(extraction.bank_rows(tx.page_text(F.col("source")), F.lit(0))).alias("r"))
    return found.select("source_id", "r.period", "r.value", "r.open_result", "r.pattern_ord")


_ROWS = f"""
    e AS (SELECT user_id AS u, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth, user_id % 5 AS kind, user_id // 5 % 4 AS what, user_id // 20 % 2 = 1 AS strict FROM events),
    r AS (SELECT u, kind, what, strict, (365 - nth % 365)::INT AS period, substr('{SYMBOLS}', (u % 12 + 1)::INT, 1) || substr('{SYMBOLS}', ((u % 12 + 1 + event_id % 11) % 12 + 1)::INT, 1) AS value,
                 lpad((event_id % 49 + 1)::VARCHAR, 2, '0') AS result FROM e)"""
_PARSER = f"list_extract({list(PARSERS)}, kind::INT + 1)"

ORACLE = {
    "registry_blocks": f"""
        WITH {_ROWS},
        s AS (SELECT DISTINCT u, kind, what, CASE WHEN kind = 2 OR what = {GOOD} OR (what = {LOOSE} AND (kind = 4 OR (kind = 0 AND NOT strict))) THEN 'ok'
                     WHEN what = {TWICE} THEN 'ambiguous' WHEN what = {NO_STOP} THEN 'stop_missing' ELSE 'ambiguous_loose' END AS status FROM r)
        SELECT u AS source_id, {_PARSER} AS parser, status, period, value, CASE kind WHEN 4 THEN '√' ELSE result END AS open_result FROM s JOIN r USING (u, kind, what) WHERE status = 'ok'
        UNION ALL SELECT u, {_PARSER}, status, 3, '狗猪', '55' FROM s WHERE kind = 2 AND what <> {LOOSE}
        UNION ALL SELECT u, {_PARSER}, status, NULL, NULL, NULL FROM s WHERE status <> 'ok'""",
    "bank_union_full": f"""
        WITH {_ROWS}
        SELECT u AS source_id, period, value, result AS open_result, 0 AS pattern_ord FROM r WHERE kind <> 4
        UNION ALL SELECT DISTINCT u, 3, '狗猪', '55', 0 FROM r WHERE kind <> 4 AND what <> {LOOSE}""",
}

QUERIES = {name: globals()[name] for name in ORACLE}
