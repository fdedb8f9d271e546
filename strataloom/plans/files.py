"""Queries over files: configurations, a history, failure lines and posts, written from the tables and read back.

The files have the faults that the rows' numbers ask for; the SQL twins tell which rule names which row.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import status
from strataloom.schema import SYMBOLS
from strataloom.sources import readers, scratch


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch.shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))


def _configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources: one file per nation, a JSON array each."""
    k = F.col("k")
    pick = F.when(k % 7 == 1, "left").when(k % 2 == 0, "最上").otherwise("last")
    url = F.concat(F.when(k % 11 == 2, F.lit("ftp")).otherwise(F.lit("https")), F.lit("://s"), k.cast("string"), F.lit(".example.test/topic/"), k.cast("string"), F.lit(".html"))
    named = k % 5 == 0
    item = F.struct(
        F.when(k % 13 == 3, " ").otherwise(F.col("name")).alias("name"), pick.alias("pick"), url.alias("url"), F.when(named, "named_block").otherwise("generic_two_zodiac").alias("parser"), F.lit("t").alias("title"),
        F.when(named & (k % 10 == 0), "(?P<period>x)(?P<zodiac>y)").when(named, "(?P<period>x)(?P<zodiac>y)(?P<open>z)").when(k % 17 == 4, "(open").otherwise("").alias("record"),
        F.when(k % 19 == 5, "post").otherwise("page").alias("payload"), (k % 23 == 6).alias("strict_block"), (k % 29 == 7).alias("detail_enrich"),
        F.when(k % 31 == 8, F.array(F.lit("https://*.example.test"))).otherwise(F.array().cast("array<string>")).alias("allowed_redirect_origins"), F.when(k % 37 == 9, 1).alias("colour"))
    files = _suppliers(spark, sf_dir).groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("k", item.alias("item")))).alias("l"))
    path = _fresh(spark, "configuration")
    files.select("nation", F.concat(F.lit("﻿"), F.to_json(F.transform("l", lambda x: x["item"]))).alias("value")).write.partitionBy("nation").text(path)
    return readers.read_sources(spark, path)


def config_rows(spark, sf_dir):
    """Every source as it is read: its place in its file, direction, lists and flags."""
    rows = _configuration(spark, sf_dir)
    return rows.select("url", "source_ord", "name", readers.direction(F.col("pick")).alias("direction"), "strict_block", F.size("allowed_redirect_origins").cast("long").alias("n_origins"), F.array_join("unknown", ",").alias("unknown"))


def config_violations(spark, sf_dir):
    return readers.source_violations(_configuration(spark, sf_dir), ("named_block", "generic_two_zodiac")).where("rule <> 'repeated_name'").select("rule", F.regexp_extract("key", r"topic/(\d+)", 1).cast("long").alias("k"), "detail")


NEWEST = 5
KIND = readers.POSITION_KIND


def _history_file(spark: SparkSession, sf_dir: str) -> str:
    """Users as the sources of a history: the file's format has them in one JSON object, one entry per source."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    u = F.col("user_id")
    issues = [(NEWEST - k - 1) % 365 + 1 for k in range(10)]
    row = lambda p, i: F.struct(F.get(F.array(*map(F.lit, issues)), i).alias("period"), F.concat(F.substring(F.lit(SYMBOLS), (p % 11 + 1).cast("int"), F.lit(1)), F.substring(F.lit(SYMBOLS), (p % 11 + 2).cast("int"), F.lit(1))).alias("zodiac"), p.alias("position"))
    rows = F.transform(F.slice("l", 1, 10), row)
    pairs = lambda field, cast: F.map_from_entries(F.transform("rows", lambda r: F.struct(r["period"].cast("string").alias("key"), r[field].cast(cast).alias("value"))))
    per = e.select("user_id", rows.alias("rows"))
    records = F.transform("rows", lambda r, i: F.struct(r["period"].alias("period"), r["zodiac"].alias("zodiac"), (r["position"] + F.when((i == 0) & (u % 7 == 2), 1).otherwise(0)).alias("position"), F.lit(KIND).alias("position_kind"), F.array(r["position"]).alias("source_positions")))
    short = F.when(u % 5 == 1, F.slice(records, 2, F.lit(10))).otherwise(records)
    values = F.when(u % 11 == 3, F.map_concat(F.map_filter(pairs("zodiac", "string"), lambda k, v: k != str(NEWEST)), F.create_map(F.lit(str(NEWEST)), F.lit("牛牛")))).otherwise(pairs("zodiac", "string"))
    entry = F.struct(
        F.concat(F.lit("u"), u.cast("string")).alias("name"), F.lit("https://a.test/").alias("url"), F.when(u % 13 == 4, "left").otherwise("top").alias("pick"),
        F.when(u % 17 == 5, "old").otherwise(KIND).alias("position_kind"), values.alias("values"), pairs("position", "long").alias("positions"), short.alias("records"))
    whole = per.agg(F.array_sort(F.collect_list(F.struct("user_id", F.to_json(entry).alias("e")))).alias("l"))
    head = json.dumps({"schema": readers.SCHEMA_VERSION, "position_kind": KIND, "window_size": 10, "issues": issues})[:-1]
    file = F.concat(F.lit(f'{head}, "sites": ['), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]}"))
    path = _fresh(spark, "history-file")
    whole.select(file.alias("value")).coalesce(1).write.text(path)
    return path


def history_file_rows(spark, sf_dir):
    rows, _ = readers.read_history(spark, _history_file(spark, sf_dir))
    return rows.select("name", "source_ord", "pick", "period", "value", "position")


def history_file_violations(spark, sf_dir):
    return readers.history_violations(*readers.history_entries(spark, _history_file(spark, sf_dir))).select("rule", F.substring_index("key", " ", 1).alias("name"))


def failure_lines(spark, sf_dir):
    """Sources that a file of failures names, and whether their lines go when every third of them has been repaired.

    Each user's line is there twice; some begin with a name that another name begins with, some with no source.
    """
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    u = F.col("user_id").cast("string")
    sources = users.select("user_id", F.concat(F.lit("u"), u).alias("name"), F.when(F.col("user_id") % 2 == 0, "top").otherwise("bottom").alias("pick"), F.concat(F.lit("https://h.test/"), u).alias("url"))
    line = F.concat_ws(" ", "name", "pick", F.concat("url", F.when(F.col("user_id") % 10 == 3, "0").otherwise("")), F.lit("timeout"))
    path = _fresh(spark, "failures")
    per = sources.select("user_id", F.array_join(F.array(line, F.lit("noise"), line), "\n").alias("value"))
    per.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("user_id", "value"))), lambda x: x["value"]), "\n").alias("value")).coalesce(1).write.text(path)
    failed = readers.read_failed(spark, path, sources)
    lines = spark.read.text(path).select(F.col("value").alias("text")).distinct()
    left = readers.without_repaired(lines, "text", failed.where("user_id % 3 = 0").select("name", "pick", "url"))
    kept = left.select(F.regexp_extract("text", r"^u(\d+) ", 1).try_cast("long").alias("user_id")).where("user_id is not null").withColumn("kept", F.lit(True))
    return failed.join(kept, "user_id", "left").select("user_id", "line", F.coalesce("kept", F.lit(False)).alias("kept"))


def forum_posts(spark, sf_dir):
    """Conversations as posts of a user, with longer texts from their details where topics agree, and whose they are."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    number = F.col("conv_id") * 10_000 + F.col("turn")
    item = F.struct(
        number.alias("id"), F.when((F.col("conv_id") % 4 == 1) & (F.col("turn") == 2), -1).otherwise(F.col("conv_id")).alias("user_id"), F.when(F.col("turn") % 3 == 0, F.lit("0")).otherwise(((F.col("conv_id") + F.col("turn")) % 400).cast("string")).alias("draw"),
        F.concat(F.col("role"), F.lit(" "), F.lpad((F.col("turn") + 1).cast("string"), 3, "0")).alias("topic"), F.col("text").alias("content"))
    bodies = t.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"])).alias("body"))
    rows = readers.posts(bodies, ["conv_id"], "body")
    topic = F.when(F.col("turn") % 2 == 0, F.concat(F.col("role"), F.lit(" "), F.lpad((F.col("turn") + 1).cast("string"), 3, "0"))).otherwise("other")
    details = t.select(number.alias("id"), topic.alias("topic"), F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit(" more"))).otherwise(F.lit("")).alias("content"))
    mine = readers.owned(rows.withColumn("who", F.col("conv_id")), ["conv_id"], "who").select("conv_id", "owned")
    full = readers.with_details(rows, details)
    return full.join(mine, "conv_id").select("conv_id", F.col("place").cast("long").alias("place"), "owned", readers.snapshot_period(F.col("draw"), F.col("topic")).alias("period"), F.char_length("content").cast("long").alias("n_chars"))


def retryable_failures(spark, sf_dir):
    """Failures with a status of their own by whether another attempt may mend them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get(F.array(*map(F.lit, (400, 401, 403, 404, 408, 410, 429, 500, 503))), (F.col("event_id") % 9).cast("int")).alias("code"))
    return e.groupBy("code", status.retryable(F.col("code")).alias("again")).agg(F.count("*").alias("n"))


_K = "(SELECT s_suppkey AS k, s_name, s_nationkey AS nation FROM supplier)"
_USERS = "(SELECT user_id AS u, row_number() OVER (ORDER BY user_id) - 1 AS ord FROM (SELECT DISTINCT user_id FROM events))"
_HISTORY = f"""(SELECT user_id AS u, event_id AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events QUALIFY i < 10)"""

ORACLE = {
    "config_rows": f"""
        SELECT CASE WHEN k % 11 = 2 THEN 'ftp' ELSE 'https' END || '://s' || k || '.example.test/topic/' || k || '.html' AS url, (row_number() OVER (PARTITION BY nation ORDER BY k) - 1)::INT AS source_ord,
               CASE WHEN k % 13 = 3 THEN ' ' ELSE s_name END AS name, CASE WHEN k % 7 = 1 THEN NULL WHEN k % 2 = 0 THEN 'top' ELSE 'bottom' END AS direction, k % 23 = 6 AS strict_block,
               (k % 31 = 8)::BIGINT AS n_origins, CASE WHEN k % 37 = 9 THEN 'colour' ELSE '' END AS unknown FROM {_K}""",
    "config_violations": f"""
        SELECT 'unknown_key' AS rule, k, 'colour' AS detail FROM {_K} WHERE k % 37 = 9
        UNION ALL SELECT 'blank_name', k, '' FROM {_K} WHERE k % 13 = 3 UNION ALL SELECT 'bad_pick', k, 'left' FROM {_K} WHERE k % 7 = 1
        UNION ALL SELECT 'bad_url', k, 'ftp://s' || k || '.example.test/topic/' || k || '.html' FROM {_K} WHERE k % 11 = 2
        UNION ALL SELECT 'bad_payload', k, 'post' FROM {_K} WHERE k % 19 = 5 UNION ALL SELECT 'detail_payload', k, CASE WHEN k % 19 = 5 THEN 'post' ELSE 'page' END FROM {_K} WHERE k % 29 = 7
        UNION ALL SELECT 'bad_pattern', k, 'record' FROM {_K} WHERE k % 5 <> 0 AND k % 17 = 4 UNION ALL SELECT 'record_group', k, 'open' FROM {_K} WHERE k % 10 = 0
        UNION ALL SELECT 'strict_parser', k, 'generic_two_zodiac' FROM {_K} WHERE k % 23 = 6 AND k % 5 <> 0 UNION ALL SELECT 'bad_origin', k, 'https://*.example.test' FROM {_K} WHERE k % 31 = 8""",
    "history_file_rows": f"""
        SELECT 'u' || u AS name, ord::INT AS source_ord, CASE WHEN u % 13 = 4 THEN 'left' ELSE 'top' END AS pick, (({NEWEST} - i - 1 + 365) % 365 + 1)::INT AS period,
               CASE WHEN i = 0 AND u % 11 = 3 THEN '牛牛' ELSE substr('{SYMBOLS}', (p % 11 + 1)::INT, 2) END AS value, p::INT AS position FROM {_HISTORY} JOIN {_USERS} USING (u)""",
    "history_file_violations": f"""
        SELECT 'bad_record' AS rule, 'u' || u AS name FROM {_USERS} JOIN (SELECT u, count(*) AS n FROM {_HISTORY} GROUP BY u) USING (u)
        WHERE (u % 7 = 2 AND NOT (u % 5 = 1)) OR (u % 11 = 3 AND NOT (u % 5 = 1))
        UNION ALL SELECT 'unequal_records', 'u' || u FROM {_USERS} WHERE u % 5 = 1
        UNION ALL SELECT 'bad_value', 'u' || u FROM {_USERS} WHERE u % 11 = 3
        UNION ALL SELECT 'bad_identity', 'u' || u FROM {_USERS} WHERE u % 13 = 4
        UNION ALL SELECT 'bad_kind', 'u' || u FROM {_USERS} WHERE u % 17 = 5""",
    "failure_lines": f"SELECT u AS user_id, (3 * ord)::INT AS line, u % 3 <> 0 AS kept FROM {_USERS} WHERE u % 10 <> 3",
    "forum_posts": """
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, NOT (conv_id % 4 = 1 AND max(turn) OVER (PARTITION BY conv_id) >= 2) AS owned,
               CASE WHEN turn % 3 <> 0 AND (conv_id + turn) % 400 BETWEEN 1 AND 365 THEN (conv_id + turn) % 400 ELSE turn + 1 END::INT AS period,
               length(coalesce(text, '')) + CASE WHEN turn % 4 = 0 THEN 5 ELSE 0 END AS n_chars FROM conversations""",
    "retryable_failures": "SELECT code, code NOT IN (400, 401, 403, 404, 410) AS again, count(*) AS n FROM (SELECT list_extract([400, 401, 403, 404, 408, 410, 429, 500, 503], event_id % 9 + 1) AS code FROM events) GROUP BY code",
}

QUERIES = {name: globals()[name] for name in ORACLE}
