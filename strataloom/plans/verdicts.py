"""Queries for verdicts and what they rest on: audits as a whole, contradictions told, exact posts, records as files hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import audit, history, report, selection
from strataloom.plans.events import events
from strataloom.sources import readers


def _history(spark, sf_dir):
    """The first event type of each user's days up to the tenth, for users but every 50th."""
    e = events(spark, sf_dir).where("day <= 10 and user_id % 50 <> 7")
    return history.first_per_period(e, ["user_id"], "day", "event_id", "event_type")


def audit_verdict(spark, sf_dir):
    """The audit of all users' histories, and of those of the users by the remainder of their number by 10 on their own."""
    rows, users = _history(spark, sf_dir), events(spark, sf_dir).select("user_id").distinct()
    counts = lambda own: audit.run_counts(own, "user_id", "day", ["event_type"], list(range(1, 11)))
    out = audit.verdict_of_counts(users, rows, counts(rows), "user_id", "day", 10).withColumn("part", F.lit(-1))
    for part, expected in ((7, 10), (3, 1)):
        own = lambda t: t.where(F.col("user_id") % 10 == part)  # noqa: B023, E731
        found = counts(own(rows))
        if part == 3:  # judged by its shorter runs alone
            found = found.withColumn("n_duplicate", F.lit(0).cast("long"))
        out = out.unionByName(audit.verdict_of_counts(own(users), own(rows), found, "user_id", "day", expected).withColumn("part", F.lit(part)))
    return out


def conflict_details(spark, sf_dir):
    return selection.conflict_details(events(spark, sf_dir), ["user_id", "day"], "event_type", "event_id")


def record_json(spark, sf_dir):
    """Each event as a record: with places of its own or without, with evidence or without, of an article or not."""
    k = F.col("event_id")
    places = F.when(k % 3 == 0, F.array(k, k + 1)).otherwise(F.array().cast("array<bigint>"))
    evidence = F.when(k % 4 == 0, F.array(F.struct(F.lit("page").alias("document_label"), k.alias("position")))).otherwise(F.expr("cast(array() as array<struct<document_label:string,position:bigint>>)"))
    text = report.record_json(F.col("day"), F.col("event_type"), k, places, F.lit(readers.POSITION_KIND), F.when(k % 5 == 0, report.ARTICLES).otherwise("page"), F.when(k % 10 == 0, "").otherwise(k.cast("string")), evidence)
    return events(spark, sf_dir).select("event_id", text.alias("json"))


def exact_posts(spark, sf_dir):
    """Conversations as posts, the one of period 3 being asked for: it may be absent, double, of another author or without an id."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    c = F.col("conv_id")
    draw = F.when((c % 6 == 1) & (F.col("turn") == 1), 3).otherwise(F.col("turn") + 1)
    item = F.struct(
        F.when(c % 6 == 2, 0).otherwise(c * 100 + F.col("turn")).alias("id"), draw.cast("string").alias("draw"), F.when(c % 6 == 3, "other").otherwise(" 杀肖 ").alias("topic"),
        F.when(c % 6 == 4, "draft").otherwise("published").alias("status"), F.struct(F.when(c % 6 == 5, "you").otherwise("me").alias("nickname")).alias("user"))
    bodies = t.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"])).alias("body"))
    found = readers.exact_posts(readers.posts(bodies, ["conv_id"], "body"), ["conv_id"], F.lit(3), "杀肖", F.lit("me"))
    return found.select("conv_id", "status", F.col("place").cast("long").alias("place"), "id")


ORACLE = {
    "audit_verdict": """
        WITH e AS (SELECT user_id AS u, day(ts) AS d, arg_min(event_type, event_id) AS t FROM events WHERE day(ts) <= 10 AND user_id % 50 <> 7 GROUP BY ALL),
        p AS (SELECT a.u AS x, b.u AS y, a.d, a.d - row_number() OVER (PARTITION BY a.u, b.u ORDER BY a.d) AS g FROM e a JOIN e b ON a.d = b.d AND a.t = b.t AND a.u < b.u),
        r AS (SELECT x, y, max(n) AS n FROM (SELECT x, y, g, count(*) AS n FROM p GROUP BY ALL) GROUP BY x, y HAVING max(n) >= 3),
        c AS (SELECT user_id AS u, count(DISTINCT e.d) AS n FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN e ON e.u = user_id GROUP BY ALL),
        q(part, expected) AS (VALUES (-1, 10), (7, 10), (3, 1)),
        v AS (SELECT part, (SELECT count(*) FROM c WHERE n = 0 AND (part < 0 OR u % 10 = part)) AS n_missing, (SELECT count(*) FROM c WHERE n BETWEEN 1 AND expected - 1 AND (part < 0 OR u % 10 = part)) AS n_incomplete,
                     (SELECT count(*) FROM r WHERE n >= 6 AND part <> 3 AND (part < 0 OR (x % 10 = part AND y % 10 = part))) AS n_duplicate,
                     (SELECT count(*) FROM r WHERE n < 6 AND (part < 0 OR (x % 10 = part AND y % 10 = part))) AS n_suspicious FROM q)
        SELECT part, CASE WHEN n_missing + n_incomplete + n_duplicate > 0 THEN 2 WHEN n_suspicious > 0 THEN 1 ELSE 0 END AS code, n_missing, n_incomplete, n_duplicate, n_suspicious FROM v""",
    "conflict_details": """
        SELECT user_id, day(ts)::INT AS day, CASE WHEN count(DISTINCT event_type) > 1 THEN 'values' ELSE 'places' END AS kind, string_agg(event_type || '@' || event_id, ',' ORDER BY event_id, event_type) AS details
        FROM events GROUP BY user_id, day(ts) HAVING count(*) > 1""",
    "record_json": """
        SELECT event_id, '{"period":' || day(ts) || ',"zodiac":"' || event_type || '","position":' || event_id || ',"source_positions":[' || CASE WHEN event_id % 3 = 0 THEN event_id || ',' || (event_id + 1) ELSE event_id::VARCHAR END
               || '],"position_kind":"visible_text_offset_v1"' || CASE WHEN event_id % 4 = 0 THEN ',"evidence":[{"document_label":"page","position":' || event_id || '}]' ELSE '' END
               || CASE WHEN event_id % 5 = 0 AND event_id % 10 <> 0 THEN ',"article_id":"' || event_id || '"' ELSE '' END || '}' AS json FROM events""",
    "exact_posts": """
        WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, CASE WHEN conv_id % 6 = 1 AND turn = 1 THEN 3 ELSE turn + 1 END AS draw FROM conversations),
        g AS (SELECT conv_id, count(*) FILTER (draw = 3) AS n, min(place) FILTER (draw = 3) AS place, min(turn) FILTER (draw = 3) AS turn FROM t GROUP BY conv_id),
        s AS (SELECT *, CASE WHEN n = 0 THEN 'not_published' WHEN n > 1 THEN 'conflict' WHEN conv_id % 6 IN (3, 4, 5) THEN 'target_missing' WHEN conv_id % 6 = 2 THEN 'field_validation' ELSE 'ok' END AS status FROM g)
        SELECT conv_id, status, CASE status WHEN 'ok' THEN place END AS place, CASE status WHEN 'ok' THEN conv_id * 100 + turn END AS id FROM s""",
}

QUERIES = {name: globals()[name] for name in ORACLE}
