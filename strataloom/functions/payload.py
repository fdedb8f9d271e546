"""Payloads and the addresses they come from: decoding, article records in JSON, soft failures, references, ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import urls
from strataloom.functions.status import strict_base64
from strataloom.functions.text import decode_entities
from strataloom.sources.scratch import written

# Marks of challenge pages, places of encoded text, paths of data scripts and of nested documents, and
# the payloads whose pages may load data scripts; encodings that pages have, and what the characters of a guess count.
CHALLENGES = ("just a moment", "cf-chl", "checking your browser", "captcha challenge")
ENCODED = (r"""(?:strdecode|atob|decodeB64)\(\s*["']([^"']*)["']\s*\)""", r"""__PAGE_DATA__\s*=\s*["']([^"']*)["']""")
DATA_SCRIPT = r"^/upload/script/.*\.js$"
NESTED = r"\.js$|/topic/|/bbs|/htm/|/article"
SCRIPT_PAYLOADS = ("page_and_scripts", "curl_tls10_page_and_scripts", "scripts", "topic_list_detail")
ARTICLE_ROUTE = r"(?i)(?<![A-Za-z0-9])/?article/(?:admin|manager|lottery)/([^/?#\"'\s]+)"
TEMPLATE = r"[{}\[\]]"
ENCODINGS = ("utf-8", "gb18030", "gbk")
MARK_WEIGHT, BROKEN_WEIGHT = 3, 20


def decoded_blocks(source: Column) -> Column:
    """The texts that a page holds as base64, in the order of its calls and then of its assignments; bad ones are left out."""
    found = F.concat(*[F.regexp_extract_all(source, F.lit(p), F.lit(1)) for p in ENCODED])
    return F.array_join(F.array_compact(F.transform(found, strict_base64)), "\n")


def decoded_record(title: Column, html: Column) -> Column:
    """struct<status, text> of an article's base64 title and body: ok, missing, undecodable or blank."""
    parts = [(c, strict_base64(c)) for c in (title, html)]
    status = F.lit("ok")
    for raw, text in reversed(parts):  # the first field that is wrong decides
        status = F.when(F.coalesce(raw, F.lit("")) == "", "missing").when(text.isNull(), "undecodable").when(F.trim(F.regexp_replace(text, "(?U)\\s+", " ")) == "", "blank").otherwise(status)
    return F.struct(status.alias("status"), F.when(status == "ok", F.concat_ws("\n", *[t for _, t in parts])).alias("text"))


def is_soft_failure(source: Column) -> Column:
    """Whether a page is blank or a challenge, which another attempt may mend."""
    low = F.lower(source)
    return F.coalesce(F.trim(F.regexp_replace(low, "(?U)\\s+", " ")) == "", F.lit(True)) | low.rlike("|".join(CHALLENGES))


def best_decoding(content: Column, declared: Column, guessed: Column) -> Column:
    """The text of bytes in the encoding that gives the most characters of the pages' language and the fewest broken ones.

    Candidates in order: the declared one, the guessed one unless it is UTF-7, and ENCODINGS; the first best one counts.
    """
    @F.pandas_udf("string")
    def decode(contents: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        def one(raw: bytes, names: tuple) -> str:
            best, most = "", None
            for name in dict.fromkeys(n for n in names if n):
                try:
                    text = bytes(raw).decode(name, "replace")
                except LookupError:
                    continue
                score = sum("一" <= c <= "鿿" for c in text) + MARK_WEIGHT * text.count("期") - BROKEN_WEIGHT * text.count("�")
                if most is None or score > most:
                    best, most = text, score
            return best

        own = [None if (g or "").lower().replace("-", "") == "utf7" else g for g in second]
        return pd.Series([None if c is None else one(c, (d, g, *ENCODINGS)) for c, d, g in zip(contents, first, own)])

    return decode(content, declared, guessed)


#: Levels of a tree that one plan walks; deeper trees are written and read again between plans.
LEVELS = 12


def json_depth(json: Column) -> Column:
    """How deep brackets are nested in a JSON text, strings left out; at least as deep as its objects and arrays are."""
    # escapes go first: a repeated choice of characters takes a frame of Java's stack for each of them
    brackets = F.regexp_replace(F.regexp_replace(F.regexp_replace(json, r"(?s)\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]+", "")
    step = lambda acc, c: F.struct((acc["at"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("at"), F.greatest(acc["most"], acc["at"] + 1).alias("most"))
    return F.aggregate(F.split(F.regexp_replace(brackets, r"^$", "{"), ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


def json_nodes(docs: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, path, node variant) of all objects and arrays of a JSON text; root has the path root.

    Each level is one lateral explode of the level above: the tree is walked by rows, level by level, as many as the
    deepest text has. Texts that are no JSON, or deeper than the parser takes (1000 levels), have no nodes.
    """
    deepest = docs.agg(F.max(json_depth(F.col(json))).alias("n")).first()["n"] or 0
    level = docs.select(*keys, F.lit("root").alias("path"), F.try_parse_json(json).alias("node")).where("node is not null")
    every, spark = level, docs.sparkSession
    for depth in range(1, deepest):
        child = spark.tvf.variant_explode(F.col("node").outer())
        name = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        inner = F.schema_of_variant("value")
        level = level.lateralJoin(child).where(F.startswith(inner, F.lit("OBJECT")) | F.startswith(inner, F.lit("ARRAY"))).select(
            *keys, F.concat("path", name).alias("path"), F.col("value").alias("node"))
        if depth % LEVELS == 0:
            level = written(level, "json-level")
            if level.isEmpty():
                break
        every = every.unionByName(level)
    return every


def article_record(docs: DataFrame, keys: list[str], json: str, article: str) -> DataFrame:
    """Per document (keys, article) with an article or more: n_articles, n_found, path, title, html of the wanted one, status.

    An article is an object with an id, a title and a body of text. status: ok, none (no article has the id) or
    ambiguous (several have).
    """
    nodes = json_nodes(docs, [*keys, article], json)
    text = lambda f: F.when(F.schema_of_variant(F.try_variant_get("node", f"$.{f}", "variant")) == "STRING", F.try_variant_get("node", f"$.{f}", "string"))
    rows = nodes.select(*keys, article, "path", F.try_variant_get("node", "$.id", "string").alias("_id"), text("title").alias("_title"), text("html").alias("_html"))
    rows = rows.where((F.coalesce("_id", F.lit("")) != "") & F.col("_title").isNotNull() & F.col("_html").isNotNull())
    mine = F.col("_id") == F.col(article)
    got = rows.groupBy(*keys, article).agg(F.count("*").alias("n_articles"), F.count_if(mine).alias("n_found"), F.min(F.when(mine, F.struct("path", F.col("_title").alias("title"), F.col("_html").alias("html")))).alias("r"))
    status = F.when(F.col("n_found") > 1, "ambiguous").when(F.col("n_found") == 0, "none").otherwise("ok")
    one = lambda c: F.when(status == "ok", F.col(f"r.{c}")).alias(c)
    return got.select(*keys, article, "n_articles", "n_found", status.alias("status"), one("path"), one("title"), one("html"))


def has_boundary(source: Column, article: Column) -> Column:
    """Whether the only article that a page's routes name is this one."""
    return F.array_distinct(F.regexp_extract_all(decode_entities(source), F.lit(ARTICLE_ROUTE), F.lit(1))) == F.array(article)


def article_id(url: Column) -> Column:
    """The id of the article that an address names; null if it names none."""
    found = F.regexp_extract(urls.path(url), r"/article/(?:admin|manager|lottery)/([^/?#]+)", 1)
    return F.when(found != "", found)


def user_id(url: Column) -> Column:
    """The id of the user that an address names, in its fragment if it has one; null if it names none."""
    where = F.when(urls.fragment(url) != "", urls.fragment(url)).otherwise(urls.path(url))
    found = F.regexp_extract(where, r"(?:^|/)users/(\d+)", 1)
    return F.when(found != "", found)


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def article_api(url: Column) -> Column:
    return F.concat(_host(url), F.lit("/api/proxy/admin-articles/"), article_id(url))


def forums_api(url: Column) -> Column:
    return F.concat(_host(url), F.lit("/api/v1/users/"), user_id(url), F.lit("/forums"))


def landing_api(url: Column) -> Column:
    slug = F.trim(F.url_decode(urls.query_value(url, "url")))
    return F.when(slug != "", F.concat(_host(url), F.lit("/api/proxy/landing-page-data?url="), F.replace(F.replace(F.url_encode(slug), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))))


def is_nested_document(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), r"\?.*$", "").rlike(NESTED)


def is_data_script(url: Column, payload: Column) -> Column:
    return payload.isin(*SCRIPT_PAYLOADS) & urls.origin(url).isNotNull() & F.lower(urls.path(url)).rlike(DATA_SCRIPT)


def _matches(url: Column, pattern: Column) -> Column:
    return F.coalesce((pattern != "") & F.rlike(url, F.concat(F.lit("(?i)^(?:"), pattern, F.lit(")"))), F.lit(False))


def may_follow(url: Column, owner: Column, allowed: Column, api: Column, pattern: Column) -> Column:
    """Whether a page may lead to an address: no template in it, and its owner's origin, a listed one, the API or the pattern."""
    origin = urls.origin(url)
    same = (F.coalesce(api, F.lit("")) != "") & (urls.without_fragment(url) == urls.without_fragment(api))
    reach = (origin == urls.origin(owner)) | F.array_contains(F.transform(allowed, urls.origin), origin) | same | _matches(url, pattern)
    return ~url.rlike(TEMPLATE) & origin.isNotNull() & F.coalesce(reach, F.lit(False))


def may_load_script(url: Column, owner: Column, allowed: Column, api: Column, pattern: Column, payload: Column) -> Column:
    """As may_follow(), or a data script of a payload that has some."""
    return may_follow(url, owner, allowed, api, pattern) | (~url.rlike(TEMPLATE) & is_data_script(url, payload))


def is_required_script(url: Column, payload: Column, pattern: Column) -> Column:
    return (payload == "scripts") | F.lower(urls.path(url)).rlike(DATA_SCRIPT) | _matches(url, pattern)


def period_argument(text: Column) -> Column:
    """The period that an argument names: three digits, with or without the mark of a period; null for others."""
    digits = F.regexp_extract(F.trim(text), "^([0-9]{3})期?$", 1)
    return F.when(digits.try_cast("int").between(1, 365), digits.try_cast("int"))


def listing_matches(title: Column, pattern: Column, name: Column, keywords: Column, markers: list[str]) -> Column:
    """Whether an entry of a listing is a source's: by its pattern if it has one, else its name, a keyword and a marker."""
    some = F.exists(keywords, lambda k: F.contains(title, k)) | (F.size(keywords) == 0)
    by_name = F.contains(title, name) & some & F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(title, m))
    return F.when(F.coalesce(pattern, F.lit("")) != "", F.rlike(title, pattern)).otherwise(by_name)
