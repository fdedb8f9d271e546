"""Queries over document sets made from the events: pairs of heading and body, boundaries, walks, crawls, the full history.

A source is a user. Its documents are written from all its events and from what the user's number asks for: documents
that agree, that contradict each other, that are not linked, and so on; the SQL twins follow from the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.functions import urls
from strataloom.operators import bundles, crawl, history, period, walk
from strataloom.schema import SYMBOLS
from strataloom.sources import scratch, sinks

ROW = r"([0-9]{3})期:【(.{2})】"
TYPES = ("click", "error", "purchase", "signup", "view")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")


def value(event_type: Column, shift: int) -> Column:
    """A value of two symbols for a type of event."""
    t = F.array_position(F.array(*map(F.lit, TYPES)), event_type).cast("int")
    return F.concat(F.substring(F.lit(SYMBOLS), t, F.lit(1)), F.substring(F.lit(SYMBOLS), t + shift, F.lit(1)))


def _set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(docs, sources): a page and a script of each user, by the user's number modulo 6.

    0 both have the rows; 1 the script has other values; 2 the script is not linked; 3 the page has two values of each
    period; 4 only the script has rows; 5 the script is of another origin. Rows go down from period 9.
    """
    e = events(spark, sf_dir)
    per = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("l"))
    u, k = F.col("user_id"), F.col("user_id") % 6
    line = lambda i, v: F.concat(F.lpad((F.pmod(8 - i, F.lit(365)) + 1).cast("string"), 3, "0"), F.lit("期:【"), v, F.lit("】"))
    rows = lambda *shifts: F.array_join(F.flatten(F.transform("l", lambda x, i: F.array(*[line(i, value(x["event_type"], s)) for s in shifts]))), " ")
    doubled = F.regexp_replace(rows(5, 6), "^009期:【..】 009期:【..】 ?", "")
    home = F.concat(F.lit("https://h.example/"), u.cast("string"))
    file = F.concat(F.lit("/upload/script/"), u.cast("string"), F.lit(".js"))
    script = F.when(k == 5, F.concat(F.lit("https://far.example/data/"), u.cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("https://h.example"), file))
    link = F.when(k == 2, F.concat(F.lit('<script src="'), file, F.lit('2"></script>'))).otherwise(F.concat(F.lit('<script src="'), F.when(k == 5, script).otherwise(file), F.lit('"></script>')))
    name = F.concat(F.lit("源"), u.cast("string"), F.lit("站"))
    page = F.concat_ws(" ", name, link, F.when(k.isin(0, 1), rows(5)).when(k == 3, doubled))
    none, far = F.lit(""), F.when(k == 5, script).otherwise(file)
    docs = per.select(u.alias("source"), F.inline(F.array(
        F.struct(F.lit("page").alias("document"), home.alias("url"), none.alias("parent_url"), none.alias("link_reference"), page.alias("text")),
        F.struct(F.lit("script").alias("document"), script.alias("url"), home.alias("parent_url"), far.alias("link_reference"), F.when(k == 1, rows(6)).otherwise(rows(5)).alias("text")))))
    docs = docs.withColumns({"record_id": none, "own_record_id": none, "identity_inherited": F.lit(False)})
    empty = F.array().cast("array<string>")
    sources = per.select(u.alias("source"), name.alias("name"), empty.alias("keywords"), home.alias("url"), F.lit("page_and_scripts").alias("payload"), none.alias("pattern"), empty.alias("allowed"), none.alias("expected"))
    return docs, sources


def rows_of(docs: DataFrame, sources: DataFrame, start: Column) -> DataFrame:
    """Rows of documents that have their source's name, from a place on."""
    owned = docs.join(sources.select("source", "name"), "source").where(F.contains("text", F.col("name")))
    found = owned.select("source", "document", F.lit("top").alias("pick"), "record_id", start.alias("_start"), F.explode(tx.matches(F.col("text"), ROW, (1, 2))).alias("m"))
    return found.where(F.col("m.offset") >= F.col("_start")).select(
        "source", "document", "pick", F.col("m.offset").alias("position"), F.col("m.g0").cast("int").alias("period"), F.col("m.g1").alias("value"), "record_id")


def pair_consensus(spark, sf_dir):
    docs, sources = _set(spark, sf_dir)
    docs = scratch.written(docs, "bundle-documents")
    pairs = scratch.written(bundles.linked_pairs(docs, sources), "bundle-pairs")
    choose = lambda rows: period.by_document(period.for_periods(scratch.written(rows, "bundle-rows"), [8]))  # noqa: E731  parsed once
    single, paired = choose(rows_of(docs, sources, F.lit(0))), choose(rows_of(pairs, sources, F.col("body_start")))
    return bundles.pair_consensus(single, paired, docs, pairs, sources, [8]).select("source", "requested", "status", "value", "carrier", "how", "n_single", "n_paired")


def boundary_violations(spark, sf_dir):
    """The same sets with records: some documents name another one, have lost their parent or its link."""
    docs, sources = _set(spark, sf_dir)
    docs = scratch.written(docs, "bundle-documents")
    u, script = F.col("source"), F.col("document") == "script"
    record = F.when(script & (u % 7 == 1), "topic:9").when(script & (u % 7 == 2), "").otherwise("topic:1")
    docs = docs.withColumn("record_id", record).withColumn("own_record_id", F.when(u % 11 == 3, "topic:2").otherwise("")).withColumn("identity_inherited", script | (u % 13 == 4))
    docs = docs.withColumn("parent_url", F.when(script & (u % 5 == 1), F.lit("https://h.example/none")).otherwise(F.col("parent_url")))
    docs = docs.withColumn("link_reference", F.when(script & (u % 17 == 5), "").otherwise(F.col("link_reference")))
    return bundles.violations(docs, sources.withColumn("expected", F.when(u % 2 == 0, "topic:1").otherwise("")))


NEWEST, CYCLE = 100, 12


def history_walk(spark, sf_dir):
    """A user's events as rows of several cycles of CYCLE periods, newest first for even users, last for odd ones.

    Every 40th event repeats the period before it with a value of its own, every 31st leaves its period out.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id")
    e = events(spark, sf_dir).withColumn("nth", F.row_number().over(w) - 1).withColumn("all", F.count("*").over(W.partitionBy("user_id")))
    nth = F.when(F.col("user_id") % 2 == 0, F.col("nth")).otherwise(F.col("all") - 1 - F.col("nth"))
    step = F.greatest(nth - F.when(F.col("event_id") % 40 == 0, 1).otherwise(0), F.lit(0))
    rows = e.where("event_id % 31 <> 0").select(
        F.col("user_id").alias("source"), F.col("event_id").alias("place"), (NEWEST - step % CYCLE).cast("int").alias("period"), value(F.col("event_type"), 5).alias("value"), F.lit(NEWEST).alias("requested"))
    return walk.history_walk(rows, ["source"], "place", F.col("source") % 2 == 0, "requested")


LAST_DAY = 20


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENTRIES of all users: the first event of each of the ten days up to LAST_DAY; every fifth user has failed last."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.dayofmonth("ts").alias("period"))
    first = e.where(F.col("period").between(LAST_DAY - 9, LAST_DAY)).groupBy("user_id", "period").agg(F.min(F.struct("event_id", "event_type")).alias("f"))
    row = F.struct((LAST_DAY + 1 - F.col("period")).alias("at"), "period", value(F.col("f.event_type"), 5).alias("value"), F.col("f.event_id").alias("position"), F.when(F.col("f.event_id") % 3 == 0, F.concat(F.lit("a"), F.col("f.event_id").cast("string"))).alias("article_id"))
    rows = first.groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    u = F.col("user_id")
    failed = u % 5 == 0
    return e.select("user_id").distinct().join(rows, "user_id", "left").select(*history._entry(
        u.cast("string"), u, F.coalesce("rows", F.array().cast(f"array<{history.ENTRY_ROW}>")), F.when(failed, "failed").otherwise("ok"), F.when(failed, F.lit("late"))))


def _results(spark: SparkSession, sf_dir: str, day: int) -> DataFrame:
    """Results of one period for all users: the first event of that day; none, or an odd first event of every seventh user, is a failure."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.dayofmonth("ts").alias("period"))
    got = e.groupBy("user_id").agg(F.min(F.when(F.col("period") == day, F.struct("event_id", "event_type"))).alias("f"))
    u, ok = F.col("user_id"), F.col("f").isNotNull() & (F.col("user_id") % 7 != 1)
    return got.select(
        u.cast("string").alias("source"), u.cast("int").alias("ord"), ok.alias("ok"), F.lit(day).alias("period"), value(F.col("f.event_type"), 6).alias("value"), F.col("f.event_id").alias("position"),
        F.when(F.col("f.event_id") % 2 == 0, F.concat(F.lit("n"), F.col("f.event_id").cast("string"))).alias("article_id"), F.when(~ok, F.lit("nothing found")).alias("error"))


def _committed(spark: SparkSession, sf_dir: str, update) -> DataFrame:
    """The stored entries as a version, the update prepared from it and committed as the next, and what a reader then sees."""
    import uuid

    path = f"{scratch.shared_folder(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    version = sinks.commit(_stored(spark, sf_dir), path, 0)
    after = update(sinks.read_version(spark, path, version))
    sinks.commit(after, path, version)
    return sinks.read_version(spark, path).select(
        "source", "ord", "fingerprint", "status", "error", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["period"].cast("string"), r["value"], r["position"].cast("string"), r["article_id"])), "|").alias("rows"))


def rolling_upsert_full(spark, sf_dir):
    return _committed(spark, sf_dir, lambda stored: history.full_update(stored, _results(spark, sf_dir, LAST_DAY + 1), LAST_DAY + 1))


def repair_rebased(spark, sf_dir):
    """Repairs of a period that the window does not have: the window moves to it; failed results touch no row of theirs."""
    return _committed(spark, sf_dir, lambda stored: history.full_repair(stored, _results(spark, sf_dir, LAST_DAY + 4), LAST_DAY + 4, LAST_DAY))


def _history_sql(day: int, repair: bool) -> str:
    v = f"substr('{SYMBOLS}', list_position({list(TYPES)}, event_type), 1) || substr('{SYMBOLS}', list_position({list(TYPES)}, event_type) + "
    good = "ok" if repair else "true"
    return f"""
        WITH e AS (SELECT event_id, user_id, event_type, day(ts) AS period FROM events),
        f AS (SELECT user_id, period, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM e GROUP BY ALL),
        u AS (SELECT DISTINCT user_id FROM e),
        n AS (SELECT u.user_id, f.event_id, f.event_type, f.event_id IS NOT NULL AND u.user_id % 7 <> 1 AS ok FROM u LEFT JOIN f ON f.user_id = u.user_id AND f.period = {day}),
        h AS (SELECT user_id, period, {v} 5, 1) AS value, event_id, CASE WHEN event_id % 3 = 0 THEN ':a' || event_id ELSE '' END AS article FROM f
              WHERE period BETWEEN {day - 9} AND {LAST_DAY}
              UNION ALL SELECT user_id, {day}, {v} 6, 1), event_id, CASE WHEN event_id % 2 = 0 THEN ':n' || event_id ELSE '' END FROM n WHERE ok),
        r AS (SELECT user_id, string_agg(value, '' ORDER BY period DESC) AS fingerprint, string_agg(period || ':' || value || ':' || event_id || article, '|' ORDER BY period DESC) AS rows FROM h GROUP BY user_id)
        SELECT n.user_id::VARCHAR AS source, n.user_id::INT AS ord, coalesce(fingerprint, '') AS fingerprint,
               CASE WHEN ok THEN 'ok' WHEN {good if not repair else 'n.user_id % 5 = 0'} THEN 'failed' ELSE 'ok' END AS status,
               CASE WHEN ok THEN NULL WHEN {good if not repair else 'false'} THEN 'nothing found' WHEN n.user_id % 5 = 0 THEN 'late' END AS error, coalesce(rows, '') AS rows
        FROM n LEFT JOIN r USING (user_id)"""


MOST, NESTED = 12, 3
FAN = 4


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sources, captured): the pages of each host as a tree of frames with links back.

    The n pages of a host are numbered by page_id. Page i leads to FAN * i + 1 ... FAN * i + FAN, to the page that leads
    to it, to itself, to the root, to another host and to an address of a template. Every 9th page has not been captured.
    """
    from pyspark.sql import Window as W

    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", urls.host(F.col("url")).alias("host"))
    p = p.withColumn("i", F.row_number().over(W.partitionBy("host").orderBy("page_id")) - 1).withColumn("n", F.count("*").over(W.partitionBy("host")))
    at = lambda i: F.concat(F.lit("https://"), F.col("host"), F.lit("/p/"), i.cast("string"))
    frame = lambda u: F.concat(F.lit("<iframe class='x' src=\""), u, F.lit("\"></iframe>"))
    below = F.filter(F.transform(F.sequence(F.lit(1), F.lit(FAN)), lambda k: F.col("i") * FAN + k), lambda j: j < F.col("n"))
    links = F.concat(
        frame(F.lit("../p/0#top")), F.array_join(F.transform(below, lambda j: frame(F.concat(F.lit("/p/"), j.cast("string")))), ""), frame(at(F.floor((F.greatest(F.col("i"), F.lit(1)) - 1) / FAN))), frame(at(F.col("i"))),
        frame(F.lit("https://elsewhere.example/p/1")), frame(F.lit("/p/{id}")))
    none = F.array().cast("array<string>")
    sources = p.where("i = 0").select(F.col("host").alias("source"), at(F.lit(0)).alias("url"), none.alias("allowed"), F.lit("").alias("api"), F.lit("").alias("pattern"))
    return sources, p.where("page_id % 9 <> 5").select(at(F.col("i")).alias("url"), F.concat("html", links).alias("text"))


def crawl_scan(spark, sf_dir):
    """The documents that each host's first page leads to within the budgets."""
    documents, _ = crawl.closure(*_site(spark, sf_dir), most=MOST, nested=NESTED)
    return documents.select("source", "place", "depth", "url", "parent_url", "link_reference", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def crawl_complete(spark, sf_dir):
    """Whether each host's scan has left nothing out."""
    return crawl.closure(*_site(spark, sf_dir), most=MOST, nested=NESTED)[1]


ENTRIES = 7


def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sources, captured): a user's events as entries of a listing of ENTRIES a page, newest first for even users.

    Every 6th entry is not the source's, every 10th has no period, every 15th repeats the first address of its page. A
    page leads to the next, the last one back to the first; every 8th user has lost the second page.
    """
    from pyspark.sql import Window as W

    # few bytes for the work on the pages made of them: partitions are not joined by their size
    e = events(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id").select("user_id", "event_id")
    order = F.when(F.col("user_id") % 2 == 0, -F.col("event_id")).otherwise(F.col("event_id")).asc_nulls_last()
    e = e.withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy(order)) - 1)
    e = e.withColumn("n", F.ceil(F.count("*").over(W.partitionBy("user_id")) / ENTRIES).cast("int")).withColumn("page", (F.floor(F.col("i") / ENTRIES) + 1).cast("int"))
    pages = e.groupBy("user_id", "n", "page").agg(F.array_sort(F.collect_list(F.struct("i", "event_id"))).alias("l"))
    u, own = F.col("user_id").cast("string"), F.transform("l", lambda x: x["event_id"])
    title = lambda i: F.concat(F.when(i % 10 == 0, F.lit("")).otherwise(F.concat(F.lpad((i % 365 + 1).cast("string"), 3, "0"), F.lit("期"))), F.when(i % 6 == 0, F.lit(" 别站")).otherwise(F.concat(F.lit(" 源"), u, F.lit("站"))), F.lit("<b>绝杀</b>二肖"))
    link = lambda i, h: F.concat(F.lit("<a class=e href='"), h, F.lit("'>"), title(i), F.lit("</a>"))
    body = F.array_join(F.transform(own, lambda i: link(i, F.concat(F.lit("/t/"), F.when(i % 15 == 0, F.get(own, F.lit(0))).otherwise(i).cast("string"), F.lit(".html")))), " ")
    further = F.concat(F.lit("<a href='#'>下一页</a><a href='/other'>下一页</a><a href='?p="), (F.col("page") % F.col("n") + 1).cast("string"), F.lit("'><i>下一页</i></a>"))
    at = lambda k: F.concat(F.lit("https://l.example/list/"), u, F.when(k == 1, F.lit("?p=1")).otherwise(F.concat(F.lit("?p="), k.cast("string"))))
    captured = pages.where(~((F.col("user_id") % 8 == 3) & (F.col("page") == 2))).select(at(F.col("page")).alias("url"), F.concat(body, further).alias("text"))
    sources = events(spark, sf_dir).select("user_id").distinct().select(
        F.col("user_id").alias("source"), at(F.lit(1)).alias("url"), F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("源"), u, F.lit("站.*二肖"))).otherwise("").alias("title"), F.concat(F.lit("源"), u, F.lit("站")).alias("name"),
        F.array(F.lit("绝杀")).alias("keywords"), F.when(F.col("user_id") % 4 < 2, "top").otherwise("bottom").alias("pick"))
    return sources, captured


def listing_scan(spark, sf_dir):
    """All entries of the listings of which no page is lost, however many pages they have, with the few of them that are in their source's window."""
    sources, captured = _listings(spark, sf_dir)
    entries, _ = crawl.listing(sources, captured, ["二肖", "两肖"], most=None)
    window = crawl.listing_targets(entries, sources, [5, 6, 7]).select("source", "place", "slot")
    return entries.join(window, ["source", "place"], "left").select("source", "place", "page", "period", "url", "slot")


def listing_status(spark, sf_dir):
    """Pages read of each listing and whether it is whole, where LONGEST pages are read at most."""
    return crawl.listing(*_listings(spark, sf_dir), ["二肖", "两肖"], most=LONGEST)[1]


LONGEST = 12
_USERS = f"""
    e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, list_position({list(TYPES)}, event_type) AS t FROM events),
    u AS (SELECT user_id AS source, user_id % 6 AS k, count(*) AS n, max(CASE WHEN nth = 2 THEN substr('{SYMBOLS}', t, 1) || substr('{SYMBOLS}', t + 5, 1) END) AS v FROM e GROUP BY user_id)"""

EXPECTED = [(NEWEST - k - 1) % 365 + 1 for k in range(10)]
_CRAWL = rf"""
    WITH RECURSIVE p AS (
        SELECT page_id, html, host, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS i, count(*) OVER (PARTITION BY host) AS n
        FROM (SELECT page_id, html, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)),
    c AS (SELECT *, page_id % 9 <> 5 AS there FROM p),
    t AS (SELECT host, i, 0 AS depth, (i - i)::BIGINT AS up, 0::BIGINT AS k, [0::BIGINT] AS path FROM c WHERE i = 0 AND there
          UNION ALL SELECT c.host, c.i, t.depth + 1, t.i, (c.i - 1) % {FAN}, list_append(t.path, (c.i - 1) % {FAN}) FROM t JOIN c ON c.host = t.host AND c.i > 0 AND (c.i - 1) // {FAN} = t.i AND c.there
          WHERE t.depth < {crawl.LEVELS} AND (c.i - 1) % {FAN} < {NESTED}),
    o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY depth, path) AS place FROM t),
    d AS (SELECT * FROM o WHERE place <= {MOST})"""
_TOO_LONG = f"WHEN max(pages) > {LONGEST} THEN 'too_long' "
_LIST = f"""
    WITH e AS (SELECT user_id AS source, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN user_id % 2 = 0 THEN -event_id ELSE event_id END) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    p AS (SELECT *, i // {ENTRIES} + 1 AS page, (n + {ENTRIES} - 1) // {ENTRIES} AS pages, first_value(event_id) OVER (PARTITION BY source, i // {ENTRIES} ORDER BY i) AS head FROM e),
    s AS (SELECT source, max(pages) AS pages, CASE WHEN source % 8 = 3 AND max(pages) >= 2 THEN 'lost' {_TOO_LONG}ELSE 'ok' END AS status FROM p GROUP BY source),
    r AS (SELECT p.source, page, i, event_id % 365 + 1 AS period, CASE WHEN event_id % 15 = 0 THEN head ELSE event_id END AS target FROM p JOIN s USING (source)
          WHERE status = 'ok' AND event_id % 6 <> 0 AND event_id % 10 <> 0),
    f AS (SELECT source, target, min(i) AS i, arg_min(page, i) AS page, arg_min(period, i) AS period FROM r GROUP BY ALL),
    g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS place FROM f),
    w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN source % 4 < 2 THEN place ELSE -place END) AS slot FROM g)"""
ORACLE = {
    "crawl_scan": _CRAWL + """
        SELECT d.host AS source, place::INT AS place, depth, 'https://' || d.host || '/p/' || d.i AS url, CASE depth WHEN 0 THEN '' ELSE 'https://' || d.host || '/p/' || up END AS parent_url,
               CASE depth WHEN 0 THEN '' ELSE '/p/' || d.i END AS link_reference, md5(html || '<iframe class=''x'' src="../p/0#top"></iframe>' || coalesce((SELECT string_agg('<iframe class=''x'' src="/p/' || j || '"></iframe>', '' ORDER BY j)
                   FROM range(d.i * FAN + 1, d.i * FAN + FAN + 1) AS x(j) WHERE j < n), '') || '<iframe class=''x'' src="https://' || d.host || '/p/' || ((greatest(d.i, 1) - 1) // FAN) || '"></iframe><iframe class=''x'' src="https://' || d.host || '/p/' || d.i
                   || '"></iframe><iframe class=''x'' src="https://elsewhere.example/p/1"></iframe><iframe class=''x'' src="/p/{id}"></iframe>') AS digest
        FROM d JOIN c ON c.host = d.host AND c.i = d.i""".replace("FAN", str(FAN)),
    "crawl_complete": _CRAWL + f"""
        SELECT h.host AS source, count(d.i) AS n_documents, count(d.i) > 0 AND NOT coalesce(bool_or((SELECT count(*) FROM c WHERE c.host = d.host AND c.i > 0 AND (c.i - 1) // {FAN} = d.i) >
               (SELECT count(*) FROM d AS x WHERE x.host = d.host AND x.depth > 0 AND x.up = d.i)), false) AS scan_complete
        FROM (SELECT DISTINCT host FROM p) AS h LEFT JOIN d ON d.host = h.host GROUP BY h.host""",
    "listing_scan": _LIST.replace(_TOO_LONG, "") + """
        SELECT source, place::INT AS place, page::INT AS page, period::INT AS period, 'https://l.example/t/' || target || '.html' AS url, CASE WHEN slot <= 3 AND period IN (5, 6, 7) THEN slot::INT END AS slot FROM w""",
    "listing_status": _LIST + f" SELECT source, CASE WHEN status = 'lost' THEN 2 ELSE least(pages, {LONGEST}) END AS n_pages, status FROM s",
    "rolling_upsert_full": _history_sql(LAST_DAY + 1, False),
    "repair_rebased": _history_sql(LAST_DAY + 4, True),
    "history_walk": f"""
        WITH e AS (SELECT user_id AS source, event_id, list_position({list(TYPES)}, event_type) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        s AS (SELECT source, source % 2 = 0 AS up, event_id, substr('{SYMBOLS}', t, 1) || substr('{SYMBOLS}', t + 5, 1) AS value,
                     {NEWEST} - greatest(CASE WHEN source % 2 = 0 THEN i ELSE n - 1 - i END - (event_id % 40 = 0)::INT, 0) % {CYCLE} AS period FROM e WHERE event_id % 31 <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN up THEN event_id ELSE -event_id END) AS k FROM s),
        g AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY k) AS run FROM (
                SELECT *, (lag(period) OVER w IS DISTINCT FROM period OR lag(value) OVER w IS DISTINCT FROM value)::INT AS new FROM o WINDOW w AS (PARTITION BY source ORDER BY k))),
        c AS (SELECT source, any_value(up) AS up, min(period) FILTER (run = 1) AS edge, count(DISTINCT run) FILTER (run <= 3 AND period = {NEWEST}) AS hits, min(k) FILTER (run <= 3 AND period = {NEWEST}) AS a,
                     max(k) FILTER (run = first_run) AS z FROM (SELECT *, min(run) FILTER (run <= 3 AND period = {NEWEST}) OVER (PARTITION BY source) AS first_run FROM g) GROUP BY source),
        d AS (SELECT c.*, CASE WHEN abs({NEWEST} - edge) > 3 THEN 'out_of_reach' WHEN hits = 0 THEN 'not_found' WHEN hits > 1 THEN 'conflict' ELSE 'ok' END AS st,
                     (SELECT min(k) FROM g WHERE g.source = c.source AND g.k > c.z AND g.period = {NEWEST}) AS stop FROM c),
        p AS (SELECT g.source, period, count(*) AS m, arg_min(value, k) AS value FROM g JOIN d USING (source)
              WHERE st = 'ok' AND k >= a AND (stop IS NULL OR k < stop) AND period IN (SELECT unnest({EXPECTED})) GROUP BY ALL),
        q AS (SELECT source, max(m) AS m, count(*) AS n, string_agg(value, '|' ORDER BY list_position({EXPECTED}, period)) AS "values", list(period) AS have FROM p GROUP BY source),
        x AS (SELECT d.source, q.*, CASE WHEN st <> 'ok' THEN st WHEN m > 1 THEN 'conflict' WHEN n < 10 THEN 'incomplete' ELSE 'ok' END AS status FROM d LEFT JOIN q ON q.source = d.source)
        SELECT source, {NEWEST} AS requested, status, CASE WHEN status IN ('ok', 'incomplete') THEN n ELSE 0 END AS n, CASE WHEN status IN ('ok', 'incomplete') THEN "values" END AS "values",
               CASE WHEN status IN ('ok', 'incomplete') THEN array_to_string(list_filter({EXPECTED}, lambda y: NOT list_contains(have, y)), ',') END AS missing FROM x""",
    "pair_consensus": f"""
        WITH {_USERS},
        s AS (SELECT *, CASE WHEN k IN (2, 5) OR (k = 3 AND n < 2) THEN 'no_rows' WHEN n < 2 THEN 'not_found' WHEN k IN (1, 3) THEN 'conflict' ELSE 'ok' END AS status FROM u)
        SELECT source, 8 AS requested, status, CASE status WHEN 'ok' THEN v END AS value, CASE WHEN status = 'ok' THEN CASE k WHEN 0 THEN 'page' ELSE 'page+script' END END AS carrier,
               CASE WHEN status = 'ok' THEN CASE k WHEN 0 THEN 'single' ELSE 'paired' END END AS how,
               (n >= 2 AND k IN (0, 1))::BIGINT AS n_single, (n >= 2 AND k IN (0, 1, 3, 4))::BIGINT AS n_paired FROM s""",
    "boundary_violations": f"""
        WITH {_USERS},
        d AS (SELECT source, k, document, document = 'script' AS s FROM u, (VALUES ('page'), ('script')) AS x(document)),
        r AS (SELECT *, CASE WHEN s AND source % 7 = 1 THEN 'topic:9' WHEN s AND source % 7 = 2 THEN '' ELSE 'topic:1' END AS record,
                     s AND source % 5 = 1 AS lost, s AND source % 17 = 5 AS mute FROM d)
        SELECT source, document, 'unbound' AS rule FROM r WHERE source % 2 = 0 AND record = ''
        UNION ALL SELECT source, document, 'mismatched' FROM r WHERE source % 2 = 0 AND record = 'topic:9'
        UNION ALL SELECT source, document, 'record' FROM r WHERE source % 11 = 3 AND record <> ''
        UNION ALL SELECT source, document, 'evidence' FROM r WHERE (s AND mute) OR (NOT s AND source % 13 = 4)
        UNION ALL SELECT source, document, 'reference' FROM r WHERE mute
        UNION ALL SELECT source, document, 'parent' FROM r WHERE lost
        UNION ALL SELECT source, document, 'parent_record' FROM r WHERE s AND NOT lost AND record = 'topic:9'
        UNION ALL SELECT source, document, 'link' FROM r WHERE s AND NOT lost AND k = 2""",
}

QUERIES = {name: globals()[name] for name in ORACLE}
