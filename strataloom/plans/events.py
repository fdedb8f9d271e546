"""Queries over the events table: source = user_id, position = event_id, period = day, value = event_type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import status, text
from strataloom.operators import audit, history, report, selection

TYPES = ["click", "error", "purchase", "signup", "view"]
LAST_DAY = 30


def top():
    """Even users list their newest rows first, odd ones last."""
    return F.col("user_id") % 2 == 0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "event_type", F.dayofmonth("ts").alias("day"), "value", "props")


def firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.first_per_period(events(spark, sf_dir), ["user_id"], "day", "event_id", "event_type")


def direction_window_top3(spark, sf_dir):
    return selection.direction_window(events(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", True)


def direction_window_bottom3(spark, sf_dir):
    return selection.direction_window(events(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", False)


def direction_window_mixed(spark, sf_dir):
    return selection.direction_window(events(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", top())


def selected_value_status(spark, sf_dir):
    return selection.selected(events(spark, sf_dir), ["user_id"], "event_id", top(), "day", "event_type", 1)


def target_distance_guard(spark, sf_dir):
    return selection.edge_distance(events(spark, sf_dir), ["user_id"], "event_id", top(), "day", 1).where(F.col("distance") > selection.MAX_EDGE_DISTANCE)


def adjacent_merge_runs(spark, sf_dir):
    runs = selection.adjacent_runs(events(spark, sf_dir), ["user_id"], "event_id", ["event_type"]).where("n >= 3")
    return runs.select("user_id", "event_type", "first_position", "last_position", "n", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def conflict_local(spark, sf_dir):
    found = selection.conflicts(events(spark, sf_dir), ["user_id", "day"], "event_type", "event_id")
    return found.where("local_signatures > 1").select("user_id", "day", "local_signatures")


def conflict_cross(spark, sf_dir):
    found = selection.conflicts(events(spark, sf_dir), ["user_id", "day"], "event_type", "event_id")
    return found.where("cross_signatures > 1").select("user_id", "day", "cross_signatures")


def history_recent10(spark, sf_dir):
    issues = list(range(LAST_DAY, LAST_DAY - 10, -1))
    return history.fingerprint(firsts(spark, sf_dir), ["user_id"], "day", "event_type", issues)


def history_missing_periods(spark, sf_dir):
    return history.missing_periods(events(spark, sf_dir), ["user_id"], "day", list(range(1, LAST_DAY + 1)))


def first_monotone_segment(spark, sf_dir):
    kept = selection.first_monotone(events(spark, sf_dir), ["user_id"], "event_id", "value")
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def step_validation_days(spark, sf_dir):
    return selection.steps(events(spark, sf_dir).select("user_id", "day").distinct(), ["user_id"], "day")


def duplicate_runs(spark, sf_dir):
    return audit.equal_runs(firsts(spark, sf_dir), "user_id", "day", ["event_type"])


def duplicate_runs_positional(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("user_id", "day").agg(F.min_by("event_type", "event_id").alias("event_type"), F.count("*").alias("place"))
    return audit.equal_runs(rows, "user_id", "day", ["event_type", "place"])


def coverage_audit(spark, sf_dir):
    return audit.incomplete(events(spark, sf_dir), "user_id", "day", LAST_DAY)



def _restated(spark, sf_dir) -> DataFrame:
    """A batch that brings day 21 and states day 20 anew, by each user's last event of the day."""
    rows = events(spark, sf_dir).where("day in (20, 21)")
    return rows.groupBy("user_id", "day").agg(F.max_by("event_type", "event_id").alias("event_type"))


def rolling_upsert(spark, sf_dir):
    past = firsts(spark, sf_dir).where("day <= 20")
    return history.rolling_update(past, _restated(spark, sf_dir), ["user_id"], "day", "event_type", F.col("event_type") == "error", list(range(12, 22)))


def repair_upsert(spark, sf_dir):
    past = firsts(spark, sf_dir).where("day <= 20")
    return history.repair(past, _restated(spark, sf_dir).where("day = 20"), ["user_id"], "day", "event_type", F.col("event_type") == "error")


def symbol_rank(spark, sf_dir):
    """Newest rows of every source, by direction, as a dense-ranked frequency table of their values."""
    window = selection.direction_window(events(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", top())
    return report.dense_ranking(window, "event_type", F.col("event_type"))


def report_text(spark, sf_dir):
    window = selection.direction_window(events(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", top())
    newest = window.where("slot = 1").withColumn("name", F.concat(F.lit("source-"), F.col("user_id").cast("string")))
    ranking = report.dense_ranking(newest, "event_type", F.col("event_type"))
    return report.report_lines(newest, "event_type", "name", "event_id", ranking, "event_type")


def failed_in_all(spark, sf_dir):
    return audit.failed_in_all(firsts(spark, sf_dir).where("day in (1, 2)"), ["user_id"], F.col("event_type") != "error", 2)


def success_gate(spark, sf_dir):
    return audit.success_gate(events(spark, sf_dir), ["user_id"], F.col("event_type") != "error")


def forum_snapshot_conflict(spark, sf_dir):
    """Days of a user whose later posts contradict the first."""
    rows = events(spark, sf_dir)
    first = rows.groupBy("user_id", "day").agg(F.min_by("event_type", "event_id").alias("primary"))
    return rows.join(first, ["user_id", "day"]).where(F.col("event_type") != F.col("primary")).groupBy("user_id", "day", "primary").agg(F.count("*").alias("n_contradicting"))


def complement_set(spark, sf_dir):
    picks = events(spark, sf_dir).groupBy("user_id", "day").agg(F.collect_set("event_type").alias("picks")).where(F.size("picks") == len(TYPES) - 2)
    return picks.select("user_id", "day", F.array_join(text.complement(TYPES, F.col("picks")), "+").alias("missing"))


def json_props_period(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, sf_dir).select((F.pmod(k - 1, F.lit(365)) + 1).alias("period")).groupBy("period").agg(F.count("*").alias("n"))


def base64_roundtrip(spark, sf_dir):
    code = F.base64(F.col("props").cast("binary"))
    broken = F.when(F.col("event_id") % 7 == 0, F.concat(code, F.lit("!"))).otherwise(code)
    return events(spark, sf_dir).select("event_id", code.alias("code"), status.strict_base64(broken).alias("decoded"))


RULES = [("conflict", "conflict"), ("timeout", "timed? ?out|timeout"), ("not_found", "404|not found"), ("empty", "^$|no data")]


def error_taxonomy(spark, sf_dir):
    v = F.floor("value").cast("int") % 5
    message = F.when(v == 0, "request timed out").when(v == 1, "status 404").when(v == 2, "conflict: 404 and 200").when(v == 3, "").otherwise("odd answer")
    return events(spark, sf_dir).where("event_type = 'error'").select(status.category(message, RULES, "other").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


E = "(SELECT event_id, user_id, event_type, day(ts) AS day, value, props FROM events)"
FIRST = f"(SELECT user_id, day, arg_min(event_type, event_id) AS event_type FROM {E} GROUP BY ALL)"
SLOTS = f"""(SELECT user_id, event_id, event_type, day, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS up,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS down FROM {E})"""
MIXED = f"(SELECT *, CASE WHEN user_id % 2 = 0 THEN up ELSE down END AS slot FROM {SLOTS})"
EDGE = f"""(SELECT user_id, edge, abs(CASE WHEN edge = 365 THEN 1 WHEN edge = 1 AND 1 = 365 THEN -1 ELSE 1 - edge END) AS distance FROM
    (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN arg_min(day, event_id) ELSE arg_max(day, event_id) END AS edge FROM {E} GROUP BY user_id))"""


def _runs_sql(rows: str, match: str) -> str:
    on = " AND ".join(f"a.{m} = b.{m}" for m in ["day", *match.split()])
    return f"""
        WITH h AS ({rows}), p AS (SELECT a.user_id AS first, b.user_id AS second, a.day FROM h a JOIN h b ON {on} AND a.user_id < b.user_id),
        i AS (SELECT *, day - row_number() OVER (PARTITION BY first, second ORDER BY day) AS island FROM p),
        r AS (SELECT first, second, count(*) AS consecutive, max(day) AS "start", min(day) AS "end" FROM i GROUP BY first, second, island)
        SELECT first, second, consecutive, "start", "end", CASE WHEN consecutive >= 6 THEN 'duplicate' ELSE 'suspicious' END AS classification
        FROM r WHERE consecutive >= 3 QUALIFY row_number() OVER (PARTITION BY first, second ORDER BY consecutive DESC, "start" DESC) = 1"""


BATCH = f"(SELECT user_id, day, arg_max(event_type, event_id) AS event_type FROM {E} WHERE day IN (20, 21) GROUP BY ALL)"

ORACLE = {
    "direction_window_top3": f"SELECT user_id, event_id, event_type, up AS slot FROM {SLOTS} WHERE up <= 3",
    "direction_window_bottom3": f"SELECT user_id, event_id, event_type, down AS slot FROM {SLOTS} WHERE down <= 3",
    "direction_window_mixed": f"SELECT user_id, event_id, event_type, slot FROM {MIXED} WHERE slot <= 3",
    "selected_value_status": f"""
        WITH w AS (SELECT user_id, count(DISTINCT (event_type, event_id)) AS n, arg_min(event_type, slot) AS v, arg_min(event_id, slot) AS p
            FROM {MIXED} WHERE slot <= 3 AND day = 1 GROUP BY user_id),
        s AS (SELECT e.user_id, edge, coalesce(n, 0) AS signatures, v, p, CASE WHEN distance > 3 THEN 'out_of_reach' WHEN n IS NULL THEN 'not_found'
            WHEN n > 1 THEN 'conflict' ELSE 'ok' END AS status FROM {EDGE} e LEFT JOIN w ON e.user_id = w.user_id)
        SELECT user_id, edge, status, signatures, CASE WHEN status = 'ok' THEN v END AS value, CASE WHEN status = 'ok' THEN p END AS position FROM s""",
    "target_distance_guard": f"SELECT user_id, edge, distance FROM {EDGE} WHERE distance > 3",
    "adjacent_merge_runs": f"""
        WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new
            FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
        SELECT user_id, event_type, min(event_id) AS first_position, max(event_id) AS last_position, count(*) AS n,
            string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS positions FROM r GROUP BY user_id, event_type, run HAVING count(*) >= 3""",
    "conflict_local": f"SELECT user_id, day, count(DISTINCT (event_type, event_id)) AS local_signatures FROM {E} GROUP BY user_id, day HAVING local_signatures > 1",
    "conflict_cross": f"SELECT user_id, day, count(DISTINCT event_type) AS cross_signatures FROM {E} GROUP BY user_id, day HAVING cross_signatures > 1",
    "history_recent10": f"""SELECT user_id, string_agg(event_type, '|' ORDER BY day DESC) AS fingerprint, count(*) AS n FROM {FIRST}
        WHERE day BETWEEN 21 AND 30 GROUP BY user_id""",
    "history_missing_periods": f"""SELECT u.user_id, d.missing FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(1, 31))::INTEGER AS missing) d
        WHERE NOT EXISTS (SELECT 1 FROM {E} e WHERE e.user_id = u.user_id AND e.day = d.missing)""",
    "first_monotone_segment": f"""
        WITH b AS (SELECT *, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS broken FROM {E}),
        s AS (SELECT *, sum(broken) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM b)
        SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM s WHERE seen = 0 GROUP BY user_id""",
    "step_validation_days": f"""
        WITH s AS (SELECT user_id, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS step FROM (SELECT DISTINCT user_id, day FROM {E}))
        SELECT user_id, count(*) AS n, bool_and(coalesce(step = 1, true)) AS valid FROM s GROUP BY user_id""",
    "duplicate_runs": _runs_sql(f"SELECT * FROM {FIRST}", "event_type"),
    "duplicate_runs_positional": _runs_sql(f"SELECT user_id, day, arg_min(event_type, event_id) AS event_type, count(*) AS place FROM {E} GROUP BY ALL", "event_type place"),
    "coverage_audit": f"SELECT user_id, count(DISTINCT day) AS n_periods FROM {E} GROUP BY user_id HAVING n_periods < 30",
    "rolling_upsert": f"""
        SELECT * FROM (SELECT h.* FROM {FIRST} h WHERE day <= 20 AND NOT EXISTS (SELECT 1 FROM {BATCH} b WHERE b.user_id = h.user_id AND b.day = h.day)
            UNION ALL SELECT * FROM {BATCH} WHERE event_type <> 'error') WHERE day BETWEEN 12 AND 21""",
    "repair_upsert": f"""
        SELECT h.user_id, h.day, coalesce(b.event_type, h.event_type) AS event_type FROM {FIRST} h
        LEFT JOIN (SELECT * FROM {BATCH} WHERE day = 20 AND event_type <> 'error') b ON b.user_id = h.user_id AND b.day = h.day WHERE h.day <= 20""",
    "symbol_rank": f"""SELECT event_type, n, dense_rank() OVER (ORDER BY n DESC) AS rank, row_number() OVER (ORDER BY n DESC, event_type) AS ordinal
        FROM (SELECT event_type, count(*) AS n FROM {MIXED} WHERE slot <= 3 GROUP BY event_type)""",
    "report_text": f"""
        WITH s AS (SELECT event_type, 'source-' || user_id AS name, event_id FROM {MIXED} WHERE slot = 1),
        c AS (SELECT event_type, count(*) AS n FROM s GROUP BY event_type),
        r AS (SELECT *, dense_rank() OVER (ORDER BY n DESC) AS rank, row_number() OVER (ORDER BY n DESC, event_type) AS o FROM c)
        SELECT 0 AS part, min(event_id) AS ordinal, event_type || ' ' || name AS line FROM s GROUP BY event_type, name
        UNION ALL SELECT 1, o, event_type || chr(9) || n || chr(9) || rank FROM r""",
    "failed_in_all": f"SELECT user_id, count(*) AS n FROM {FIRST} WHERE day IN (1, 2) GROUP BY user_id HAVING bool_and(event_type = 'error') AND count(*) = 2",
    "success_gate": f"""SELECT user_id, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) AS n FROM {E} GROUP BY user_id
        HAVING count(*) FILTER (event_type <> 'error') * 100 > count(*) * 85""",
    "forum_snapshot_conflict": f"""SELECT e.user_id, e.day, f.event_type AS primary, count(*) AS n_contradicting FROM {E} e JOIN {FIRST} f
        ON e.user_id = f.user_id AND e.day = f.day WHERE e.event_type <> f.event_type GROUP BY ALL""",
    "complement_set": f"""
        WITH p AS (SELECT user_id, day FROM {E} GROUP BY user_id, day HAVING count(DISTINCT event_type) = 3)
        SELECT user_id, day, string_agg(t, '+' ORDER BY t) AS missing FROM p CROSS JOIN (SELECT DISTINCT event_type AS t FROM events) a
        WHERE NOT EXISTS (SELECT 1 FROM {E} e WHERE e.user_id = p.user_id AND e.day = p.day AND e.event_type = t) GROUP BY user_id, day""",
    "json_props_period": "SELECT ((json_extract(props, '$.k')::INTEGER - 1 + 365) % 365 + 1) AS period, count(*) AS n FROM events GROUP BY period",
    "base64_roundtrip": "SELECT event_id, base64(props::BLOB) AS code, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS decoded FROM events",
    "error_taxonomy": """SELECT CASE floor(value)::INTEGER % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'not_found' WHEN 2 THEN 'conflict' WHEN 3 THEN 'empty' ELSE 'other' END AS category,
        count(*) AS n FROM events WHERE event_type = 'error' GROUP BY category""",
}

QUERIES = {name: globals()[name] for name in ORACLE}
