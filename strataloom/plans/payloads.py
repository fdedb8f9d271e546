"""Queries over payloads and addresses: article records in JSON, encoded text, references, ids, retry, joined documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import payload
from strataloom.operators import linking, period


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def article_search(spark, sf_dir):
    """A conversation as a JSON tree of articles, its turns; the wanted one is turn 1. Every third has it twice."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("title"), F.coalesce("text", F.lit("")).alias("html"))))).alias("l"))
    items = F.transform("l", lambda x: x["col2"])
    again = F.when(F.col("conv_id") % 3 == 0, F.filter(items, lambda x: x["id"] == "1")).otherwise(F.slice(items, 1, 0))
    json = F.to_json(F.struct(F.struct(items.alias("items")).alias("page"), again.alias("more"), F.lit(1).alias("n")))
    return payload.article_record(turns.select("conv_id", json.alias("json"), F.lit("1").alias("article")), ["conv_id"], "json", "article").select(
        "conv_id", "n_articles", "n_found", "status", "path", "title")


def _encoded(c):
    return F.base64(F.encode(c, "UTF-8"))


def article_decode(spark, sf_dir):
    """Addresses and pages as base64; some are missing, some hold a character that base64 has not, some are blank."""
    k = F.col("page_id") % 5
    title = F.when(k == 1, F.lit("")).when(k == 2, F.concat(_encoded(F.col("url")), F.lit("!"))).when(k == 3, _encoded(F.lit("  "))).otherwise(_encoded(F.col("url")))
    got = table(spark, sf_dir, "pages").select("page_id", payload.decoded_record(title, _encoded(F.col("html"))).alias("r"))
    return got.select("page_id", F.col("r.status").alias("status"), F.md5(F.encode("r.text", "UTF-8")).alias("digest"))


def encoded_blocks(spark, sf_dir):
    """Scripts that hold an address, a bad literal and the page's number, as calls and as an assignment."""
    source = F.concat(F.lit("__PAGE_DATA__ = '"), _encoded(F.col("page_id").cast("string")), F.lit("'; document.write(strdecode(\""), _encoded(F.col("url")), F.lit("\")); atob('a_b!'); decodeB64( '"), _encoded(F.lit("x")), F.lit("' )"))
    return table(spark, sf_dir, "pages").select("page_id", payload.decoded_blocks(source).alias("text"))


def soft_payloads(spark, sf_dir):
    k = F.col("page_id") % 4
    source = F.when(k == 0, F.lit(" \n ")).when(k == 1, F.concat(F.lit("<b>Just a Moment</b>"), F.col("html"))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", payload.is_soft_failure(source).alias("soft"))


def best_decoding(spark, sf_dir):
    """Texts in one of two encodings, declared as another: the one with the language's characters is found."""
    text = F.concat(F.lit("第"), F.regexp_replace("text", "[^\\x00-\\x7F]", ""), F.lit("期"))
    got = payload.best_decoding(F.encode(text, "UTF-8"), F.lit("latin-1"), F.when(F.col("doc_id") % 2 == 0, "UTF-7"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(got, "UTF-8")).alias("digest"))


PATTERN = "https?://[a-z.]*example[.]org/"


def reference_checks(spark, sf_dir):
    """Each page's address as one that the next page refers to, as a data script, and as a nested document."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    owner = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("owner"))
    allowed, none = F.array(F.lit("https://spam-farm.example.org")), F.lit("")
    script = F.concat(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), F.when(F.col("page_id") % 2 == 0, "/upload/script/a.js").otherwise("/other/${b}.js"))
    kind = F.when(F.col("page_id") % 3 == 0, "page").otherwise("scripts")
    return pages.join(owner, "page_id").select(
        "page_id", payload.may_follow(F.col("url"), F.col("owner"), allowed, none, none).alias("follow"), payload.may_follow(F.col("url"), F.lit("https://none.test/"), F.array().cast("array<string>"), none, F.lit(PATTERN)).alias("by_pattern"),
        payload.may_load_script(script, F.col("owner"), allowed, none, none, kind).alias("script"), payload.is_required_script(script, kind, none).alias("required"),
        payload.is_nested_document(F.col("url")).alias("nested"))


def url_ids(spark, sf_dir):
    """Ids of articles and users and the addresses of their interfaces, from addresses made of the pages' numbers."""
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    host = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    url = F.when(k == 0, F.concat(host, F.lit("/article/manager/a"), n, F.lit("?x=1"))).when(k == 1, F.concat(host, F.lit("/#/users/"), n)).when(k == 2, F.concat(host, F.lit("/p?url=s%20"), n)).otherwise(F.concat(host, F.lit("/x")))
    return table(spark, sf_dir, "pages").select(
        "page_id", payload.article_id(url).alias("article"), payload.user_id(url).alias("user"), payload.article_api(url).alias("article_api"), payload.forums_api(url).alias("forums_api"), payload.landing_api(url).alias("landing_api"))


def route_boundary(spark, sf_dir):
    n = F.col("page_id").cast("string")
    more = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" &quot;/article/lottery/"), n, F.lit("x&quot;"))).otherwise("")
    source = F.concat(F.lit('<a href="/article/admin/'), n, F.lit('">x</a> ARTICLE/manager/'), n, F.lit("?y"), more)
    return table(spark, sf_dir, "pages").select("page_id", payload.has_boundary(source, n).alias("bounded"))


def period_arguments(spark, sf_dir):
    n = F.lpad((F.col("event_id") % 500).cast("string"), 3, "0")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(n, F.lit("期"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), n, F.lit(" "))).otherwise(F.concat(n, F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", payload.period_argument(text).alias("period"))


def retry_application(spark, sf_dir):
    """Results of a first day, and rows of the next as their repair."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.dayofmonth("ts").alias("day"))
    old = rows.where("day = 1").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("value"))
    new = rows.where("day = 2 and event_id % 4 = 0").select("user_id", F.col("event_type").alias("value"), F.col("day").alias("position"))
    return period.apply_retry(old, new, ["user_id"])


def joined_documents(spark, sf_dir):
    """Turns of a conversation with one role as documents of one address, put together."""
    docs = table(spark, sf_dir, "conversations").select(F.col("role").alias("source"), F.col("conv_id").alias("url"), F.col("role").alias("record_id"), F.col("turn").alias("doc_ord"), F.coalesce("text", F.lit("")).alias("text"))
    return period.joined_documents(docs, "\n#\n").select("source", "url", "n", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def source_order(spark, sf_dir):
    """Customers in order of their number, against those with a balance in the same order: who is missing or moved."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return period.same_sources(rows, rows.where("s_acctbal > 0"), ["s_suppkey"], "s_suppkey")


def scripts_first(spark, sf_dir):
    """Links of each page, those to the deepest paths first, then in order of place."""
    return linking.top_links(table(spark, sf_dir, "pages"), "page_id", "html", 12, lambda link: F.length(F.regexp_replace(link, "[^/]", "")))


B64 = "to_base64(encode({}))"
HOST = "regexp_extract(url, '^([a-z]+://[^/]+)', 1)"
ORIGIN = "regexp_extract({}, '^([a-z]+://[^/]+)', 1)"
ORACLE = {
    "article_search": """
        WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations)
        SELECT conv_id, count(*) + CASE WHEN conv_id % 3 = 0 THEN count_if(turn = 1) ELSE 0 END AS n_articles, count_if(turn = 1) * CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS n_found,
               CASE WHEN count_if(turn = 1) = 0 THEN 'none' WHEN conv_id % 3 = 0 THEN 'ambiguous' ELSE 'ok' END AS status,
               CASE WHEN conv_id % 3 <> 0 THEN min(CASE WHEN turn = 1 THEN 'root.page.items[' || nth || ']' END) END AS path,
               CASE WHEN conv_id % 3 <> 0 THEN min(CASE WHEN turn = 1 THEN role END) END AS title
        FROM t GROUP BY conv_id""",
    "article_decode": """
        SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'undecodable' WHEN 3 THEN 'blank' ELSE CASE html WHEN '' THEN 'missing' ELSE 'ok' END END AS status,
               CASE WHEN page_id % 5 IN (0, 4) THEN md5(url || chr(10) || html) END AS digest FROM pages""",
    "encoded_blocks": "SELECT page_id, url || chr(10) || 'x' || chr(10) || page_id AS text FROM pages",
    "soft_payloads": """SELECT page_id, page_id % 4 <= 1 OR regexp_matches(lower(html), 'just a moment|cf-chl|checking your browser|captcha challenge') AS soft FROM pages""",
    "best_decoding": r"SELECT doc_id, md5('第' || regexp_replace(text, '[^\x00-\x7F]', '', 'g') || '期') AS digest FROM documents",
    "reference_checks": f"""
        WITH j AS (SELECT a.page_id, a.url, b.url AS owner, CASE WHEN a.page_id % 3 = 0 THEN 'page' ELSE 'scripts' END AS kind,
                          {ORIGIN.format('a.url')} = {ORIGIN.format('b.url')} OR {ORIGIN.format('a.url')} = 'https://spam-farm.example.org' AS reach
                   FROM pages a JOIN pages b ON b.page_id = a.page_id + 1)
        SELECT page_id, reach AND NOT regexp_matches(url, '[{{}}\\[\\]]') AS follow, regexp_matches(url, '^{PATTERN}') AND NOT regexp_matches(url, '[{{}}\\[\\]]') AS by_pattern,
               page_id % 2 = 0 AND (reach OR kind = 'scripts') AS script, page_id % 2 = 0 OR kind = 'scripts' AS required,
               regexp_matches(regexp_replace(lower(url), '\\?.*$', ''), '\\.js$|/topic/|/bbs|/htm/|/article') AS nested
        FROM j""",
    "url_ids": f"""
        WITH n AS (SELECT page_id, page_id % 4 AS k, {HOST} AS host FROM pages)
        SELECT page_id, CASE k WHEN 0 THEN 'a' || page_id END AS article, CASE k WHEN 1 THEN page_id::VARCHAR END AS "user",
               CASE k WHEN 0 THEN host || '/api/proxy/admin-articles/a' || page_id END AS article_api, CASE k WHEN 1 THEN host || '/api/v1/users/' || page_id || '/forums' END AS forums_api,
               CASE k WHEN 2 THEN host || '/api/proxy/landing-page-data?url=s%20' || page_id END AS landing_api FROM n""",
    "route_boundary": "SELECT page_id, page_id % 3 <> 0 AS bounded FROM pages",
    "period_arguments": "SELECT event_id, CASE WHEN event_id % 3 < 2 AND event_id % 500 BETWEEN 1 AND 365 THEN (event_id % 500)::INT END AS period FROM events",
    "retry_application": """
        WITH o AS (SELECT user_id, arg_min(event_type, event_id) AS old FROM events WHERE day(ts) = 1 GROUP BY 1),
        n AS (SELECT user_id, count(DISTINCT event_type) AS n, min(event_type) AS new FROM events WHERE day(ts) = 2 AND event_id % 4 = 0 GROUP BY 1),
        j AS (SELECT user_id, old, new, CASE WHEN n > 1 OR old <> new THEN 'conflict' WHEN old IS NULL THEN 'repaired' ELSE 'kept' END AS status FROM o FULL JOIN n USING (user_id))
        SELECT user_id, CASE WHEN status <> 'conflict' THEN coalesce(old, new) END AS value, status FROM j""",
    "joined_documents": r"""SELECT role AS source, conv_id AS url, count(*) AS n, md5(string_agg(coalesce(text, ''), chr(10) || '#' || chr(10) ORDER BY turn)) AS digest
        FROM conversations GROUP BY 1, 2 HAVING count(*) > 1""",
    "source_order": """
        WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS x FROM supplier), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS y FROM supplier WHERE s_acctbal > 0)
        SELECT s_suppkey, CASE WHEN y IS NULL THEN 'missing' ELSE 'moved' END AS rule FROM a LEFT JOIN b USING (s_suppkey) WHERE y IS NULL OR x <> y""",
    "scripts_first": """
        WITH f AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages),
        l AS (SELECT page_id, unnest(links) AS link, unnest(range(len(links))) AS place FROM f),
        g AS (SELECT page_id, link, min(place) AS place FROM l GROUP BY 1, 2),
        r AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY length(link) - length(replace(link, '/', '')) DESC, place)::INT AS slot FROM g)
        SELECT * FROM r WHERE slot <= 12""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
