"""Readers of configuration, history, failure and post files, and the checks of what they hold.

A broken file is rows of violations (rule, key, detail), never an exception on an executor.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions import text as tx
from strataloom.functions import urls
from strataloom.schema import SOURCES, SYMBOLS

# The spellings of a direction, the ways to get a document, the parsers that may be strict.
TOP_WORDS, BOTTOM_WORDS = ("top", "first", "最上", "最前"), ("bottom", "last", "最下", "最后")
STRICT_PARSERS = ("site_scoped_two_zodiac", "named_block")
RECORD_GROUPS = ("period", "zodiac", "open")
PAYLOADS = ("page", "page_and_scripts", "browser_rendered_page", "topic_list_detail", "admin_article_api", "tuku_user_forums", "curl_tls10_page_and_scripts", "scripts")
# The version, the kind of positions and the length of a history file.
SCHEMA_VERSION, POSITION_KIND, WINDOW = 2, "visible_text_offset_v1", 10

POSTS = "array<struct<id:bigint,user_id:bigint,draw:string,topic:string,content:string,status:string,user:struct<id:bigint,nickname:string>>>"


def direction(pick: Column) -> Column:
    """top, bottom, or null for another word."""
    word = F.lower(F.trim(pick))
    return F.when(word.isin(*TOP_WORDS), "top").when(word.isin(*BOTTOM_WORDS), "bottom")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a configuration file (one JSON array, a byte-order mark is allowed), in order as source_ord.

    Missing text is '', a missing list is empty, a missing flag is false. Keys outside the schema are listed in
    the column unknown, so that violations() can name them.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    names = F.array(*[F.lit(f.name) for f in SOURCES])
    items = raw.select(F.posexplode(F.from_json("value", T.ArrayType(T.StringType()))).alias("source_ord", "item"))
    rows = items.select("source_ord", F.from_json("item", SOURCES).alias("s"), F.array_sort(F.array_except(F.json_object_keys("item"), names)).alias("unknown"))
    empty = {T.StringType(): F.lit(""), T.BooleanType(): F.lit(False)}
    columns = [F.coalesce(F.col(f"s.{f.name}"), empty.get(f.dataType, F.array().cast(f.dataType))).alias(f.name) for f in SOURCES]
    return rows.select("source_ord", *columns, "unknown")


def file_violations(spark: SparkSession, path: str) -> DataFrame:
    """(rule, key, detail) of configuration files as wholes: not_json, not_a_list, empty, and items that are no objects."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("key"), F.try_parse_json(F.regexp_replace("value", "^\ufeff", "")).alias("v"))
    kind = F.schema_of_variant("v")
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array().cast("array<variant>"))
    rule = (
        F.when(F.col("v").isNull(), "not_json").when(~F.startswith(kind, F.lit("ARRAY")), "not_a_list").when(F.size(items) == 0, "empty")
        .when(F.exists(items, lambda x: ~F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))), "item_no_object"))
    return raw.select(rule.alias("rule"), "key", F.coalesce(kind, F.lit("")).alias("detail")).where("rule is not null")


def source_identity(name: str = "url", aliases: str = "allowed_redirect_origins") -> Column:
    """What a source is, whatever it is called: its least origin, its resource, and the fields that choose its rows."""
    url = F.col(name)
    origins = F.filter(F.concat(F.array(urls.origin(url)), F.transform(F.col(aliases), urls.origin)), lambda o: o.isNotNull())
    query = F.array_sort(F.filter(F.split(urls.query(url), "&"), lambda kv: (kv != "") & ~F.lower(kv).rlike("^utm_")))
    path = F.regexp_replace(urls.path(url), "/+$", "")
    plain = F.concat_ws("\u0001", F.when(path == "", "/").otherwise(path), F.array_join(query, "&"), urls.fragment(url))
    record = urls.record_identity(url)
    return F.concat_ws(
        "\u0002", F.array_min(origins), F.when(record != "", record).otherwise(plain), direction(F.col("pick")), "payload", "parser", F.trim("title"), F.trim("record"), F.trim("stop"))


def config_fingerprint(sources: DataFrame, namespace: str, fields: Sequence[str], optional: Sequence[str] = ("allowed_redirect_origins", "allowed_document_origins")) -> DataFrame:
    """One row, fingerprint: the sha256 of all sources, in order, as one JSON text with sorted keys and no spaces.

    Optional lists are left out where they are empty. The text of the configuration goes to one task: it has one
    row per source, not per document.
    """
    def item(f: str) -> Column:
        return F.concat(F.lit(json.dumps(f) + ":"), F.regexp_replace(F.to_json(F.array(F.col(f))), r"^\[|\]$", ""))

    parts = [F.when((F.size(f) > 0) if f in optional else F.lit(True), item(f)) for f in sorted([*fields, *optional])]
    entry = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    every = sources.select("source_ord", entry.alias("e")).agg(F.array_sort(F.collect_list(F.struct("source_ord", "e"))).alias("l"))
    text = F.concat(F.lit('{"project":' + json.dumps(namespace, ensure_ascii=False) + ',"sites":['), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]}"))
    return every.select(F.sha2(text, 256).alias("fingerprint"))


def _compiles(pattern: Column) -> Column:
    """Whether a pattern is well formed; the engine's own parser decides, once per different pattern."""
    @F.pandas_udf("boolean")
    def good(patterns: pd.Series) -> pd.Series:
        def one(p: str) -> bool:
            try:
                re.compile(p or "")
            except re.error:
                return False
            return True

        known = {p: one(p) for p in patterns.unique()}
        return patterns.map(known)

    return good(pattern)


def source_violations(sources: DataFrame, parsers: Sequence[str] = ()) -> DataFrame:
    """(rule, key, detail): every rule that a row of read_sources() breaks; no rows if the file is good.

    parsers: the names that may be bound; none given: names are not checked.
    """
    key = F.concat_ws(" ", "name", "pick", "url")
    bare = r"^https?://[^/?#@*]+$"
    groups = F.array(*[F.lit(g) for g in RECORD_GROUPS])
    lacking = F.filter(groups, lambda g: ~F.contains(F.col("record"), F.concat(F.lit("(?P<"), g, F.lit(">"))))
    origins = F.concat("allowed_redirect_origins", "allowed_document_origins")
    broken = [F.when(~_compiles(F.col(c)), F.lit(c)) for c in ("title", "record", "stop", "linked_document_pattern")]
    sources = sources.withColumn("_broken", F.array_compact(F.array(*broken)))
    rules = [
        ("unknown_key", F.size("unknown") > 0, F.array_join("unknown", ",")),
        ("blank_name", F.trim("name") == "", F.lit("")),
        ("bad_pick", direction(F.col("pick")).isNull(), F.col("pick")),
        ("bad_url", urls.origin(F.col("url")).isNull(), F.col("url")),
        ("repeated_parameter", F.size(urls.repeated_identity_keys(F.col("url"))) > 0, F.array_join(urls.repeated_identity_keys(F.col("url")), ",")),
        ("bad_payload", ~F.col("payload").isin(*PAYLOADS), F.col("payload")),
        ("detail_payload", F.col("detail_enrich") & (F.col("payload") != "tuku_user_forums"), F.col("payload")),
        ("unknown_parser", ~F.col("parser").isin(*parsers) if parsers else F.lit(False), F.col("parser")),
        ("bad_pattern", F.size("_broken") > 0, F.array_join("_broken", ",")),
        ("record_group", (F.col("parser") == "named_block") & (F.size(lacking) > 0), F.array_join(lacking, ",")),
        ("strict_parser", F.col("strict_block") & ~F.col("parser").isin(*STRICT_PARSERS), F.col("parser")),
        ("bad_origin", F.exists(origins, lambda o: ~o.rlike(bare)), F.array_join(F.filter(origins, lambda o: ~o.rlike(bare)), ","))]
    found = F.filter(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, bad, detail in rules]), lambda x: x.isNotNull())
    single = sources.select(key.alias("key"), F.explode(found).alias("v")).select("v.rule", "key", "v.detail")
    repeated = [
        sources.groupBy(by.alias("detail")).agg(F.count("*").alias("n"), F.min(key).alias("key")).where("n > 1").select(F.lit(rule).alias("rule"), "key", "detail")
        for rule, by in (("repeated_name", F.col("name")), ("repeated_identity", key), ("repeated_source", source_identity()))]
    for more in repeated:
        single = single.unionByName(more)
    return single


def history_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A history file as (entries, stamp); each value is kept with its JSON type, so that contracts can be checked.

    entries: source_ord and the entry's name, url, pick, position_kind, values, positions, article_ids (maps from the
    period's key to a variant) and records (array of variants). stamp: one row with schema, position_kind,
    window_size, issues (variants), whether sites is a list, and the sha256 of the file's bytes; its fields are null
    where the file is no JSON object. A file that does not exist is Spark's own error; no file is the caller's choice.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))
    raw = raw.select("sha256", F.try_parse_json(F.regexp_replace("text", "^\ufeff", "")).alias("v"))
    get = lambda field, kind: F.try_variant_get("v", f"$.{field}", kind)
    sites = get("sites", "array<variant>")
    stamp = raw.select(
        F.startswith(F.coalesce(F.schema_of_variant("v"), F.lit("")), F.lit("OBJECT")).alias("is_object"), get("schema", "int").alias("schema"),
        get("position_kind", "string").alias("position_kind"), get("window_size", "int").alias("window_size"), get("issues", "array<variant>").alias("issues"),
        sites.isNotNull().alias("has_sites"), "sha256")
    entry = lambda field, kind: F.try_variant_get("e", f"$.{field}", kind).alias(field)
    maps = [entry(c, "map<string,variant>") for c in ("values", "positions", "article_ids")]
    entries = raw.select(F.posexplode(sites).alias("source_ord", "e")).select(
        "source_ord", entry("name", "string"), entry("url", "string"), entry("pick", "string"), entry("position_kind", "string"), *maps, entry("records", "array<variant>"))
    return entries, stamp


def _whole(v: Column) -> Column:
    """A variant's whole number; null for other types, truth values included."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "long"))


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _records(name: str = "records") -> Column:
    """array<struct<period, value, position, position_kind, source_positions>> of an entry's records."""
    def record(r: Column) -> Column:
        key = F.try_variant_get(r, "$.period", "variant")
        number = F.coalesce(_whole(key), F.when(_text(key).rlike("^[0-9]+$"), _text(key).try_cast("long")))
        return F.struct(number.alias("period"), _text(F.try_variant_get(r, "$.zodiac", "variant")).alias("value"), _whole(F.try_variant_get(r, "$.position", "variant")).alias("position"),
                        F.try_variant_get(r, "$.position_kind", "string").alias("position_kind"), F.try_variant_get(r, "$.source_positions", "array<int>").alias("source_positions"))

    return F.transform(F.coalesce(name, F.array().cast("array<variant>")), record)


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A history file as (rows, stamp): (source_ord, name, url, pick, period, value, position, article_id) and history_entries()'s stamp.

    Values and positions come from the maps of an entry, or from its records where it has no such map. Periods whose
    key is not plain digits and values that are no text are left out; a position that is no whole number is null.
    """
    entries, stamp = history_entries(spark, path)
    made = lambda field, kind: F.map_from_entries(F.transform(
        F.filter(F.col("_records"), lambda r, i: r["period"].isNotNull() & r[field].isNotNull() & ~F.exists(F.slice("_records", 1, i), lambda q: q["period"] == r["period"])),
        lambda r: F.struct(r["period"].cast("string").alias("key"), r[field].alias("value"))))
    rows = entries.withColumn("_records", _records()).withColumn(
        "_values", F.when(F.col("values").isNotNull(), F.transform_values("values", lambda k, v: _text(v))).otherwise(made("value", "string"))).withColumn(
        "_positions", F.when(F.col("positions").isNotNull(), F.transform_values("positions", lambda k, v: _whole(v))).otherwise(made("position", "long")))
    rows = rows.select("source_ord", "name", "url", "pick", "_positions", "article_ids", F.explode("_values").alias("key", "value")).where(F.col("key").rlike("^[0-9]+$") & F.col("value").isNotNull())
    article = F.try_variant_get(F.try_element_at("article_ids", F.col("key")), "$", "string")
    return rows.select("source_ord", "name", "url", "pick", F.col("key").try_cast("int").alias("period"), "value",
                       F.try_element_at("_positions", F.col("key")).cast("int").alias("position"), article.alias("article_id")), stamp


def history_violations(entries: DataFrame, stamp: DataFrame) -> DataFrame:
    """(rule, key, detail): every rule of the history contract that a file breaks; no rows if it is good.

    The file: an object of this schema, kind and window, ten periods in falling order on the cycle, a list of sources.
    A source: an identity of its own, this kind, values and positions and records for the same periods of the
    window, values of two different symbols, positions that are whole numbers, records equal to values and positions.
    """
    ten = F.filter(F.transform(F.coalesce("issues", F.array().cast("array<variant>")), _whole), lambda x: x.isNotNull())
    right = (F.size("issues") == WINDOW) & (F.size(ten) == WINDOW) & F.forall(F.sequence(F.lit(1), F.lit(WINDOW)), lambda i: F.get(ten, i - 1) == F.pmod(F.get(ten, F.lit(0)) - i, F.lit(365)) + 1)
    of_file = F.array(
        F.when(~F.col("is_object"), "no_object"), F.when(~F.coalesce((F.col("schema") == SCHEMA_VERSION) & (F.col("position_kind") == POSITION_KIND), F.lit(False)), "bad_schema"),
        F.when(~F.coalesce(F.col("window_size") == WINDOW, F.lit(False)), "bad_window_size"), F.when(~F.coalesce(right, F.lit(False)), "bad_issues"), F.when(~F.col("has_sites"), "no_sources"))
    file_rows = stamp.select(F.explode(F.array_compact(of_file)).alias("rule")).select("rule", F.lit("").alias("key"), F.lit("").alias("detail"))
    window = stamp.select(F.transform(F.coalesce("issues", F.array().cast("array<variant>")), _whole).alias("_window"))
    rows = entries.crossJoin(F.broadcast(window)).withColumn("_records", _records())  # the window is one row
    number = lambda k: F.when(k.rlike("^[0-9]+$"), k.try_cast("long"))
    none = F.array().cast("array<string>")
    keys = {c: F.coalesce(F.map_keys(c), none) for c in ("values", "positions")}
    wrong_keys = lambda c: F.filter(keys[c], lambda k: ~F.coalesce(number(k).between(1, 365) & F.array_contains("_window", number(k)), F.lit(False)))
    periods = lambda c: F.array_sort(F.array_distinct(F.transform(keys[c], number)))
    legal = lambda v: F.coalesce(tx.without_separators(v).rlike(f"^(?!(.)\\1)[{SYMBOLS}]{{2}}$"), F.lit(False))
    bad_values = F.filter(keys["values"], lambda k: ~legal(_text(F.try_element_at("values", k))))
    bad_positions = F.filter(keys["positions"], lambda k: ~F.coalesce(_whole(F.try_element_at("positions", k)) >= 0, F.lit(False)))
    of_record = F.filter("_records", lambda r: ~F.coalesce(
        legal(r["value"]) & (r["position"] >= 0) & (r["position_kind"] == POSITION_KIND)
        & (tx.without_separators(r["value"]) == tx.without_separators(_text(F.try_element_at("values", r["period"].cast("string")))))
        & (r["position"] == _whole(F.try_element_at("positions", r["period"].cast("string")))), F.lit(False)))
    own = F.transform("_records", lambda r: r["period"])
    key = F.concat_ws(" ", "name", "url", "pick")
    rules = [
        ("bad_identity", ~F.coalesce((F.trim("name") != "") & (F.trim("url") != "") & F.col("pick").isin("top", "bottom"), F.lit(False)), F.lit("")),
        ("bad_kind", ~F.coalesce(F.col("position_kind") == POSITION_KIND, F.lit(False)), F.coalesce("position_kind", F.lit(""))),
        ("bad_period", F.size(F.concat(wrong_keys("values"), wrong_keys("positions"))) > 0, F.array_join(F.array_sort(F.array_distinct(F.concat(wrong_keys("values"), wrong_keys("positions")))), ",")),
        ("bad_value", F.size(bad_values) > 0, F.array_join(F.array_sort(bad_values), ",")), ("bad_position", F.size(bad_positions) > 0, F.array_join(F.array_sort(bad_positions), ",")),
        ("unequal_periods", periods("values") != periods("positions"), F.lit("")),
        ("repeated_record", F.size(F.array_distinct(own)) < F.size(own), F.lit("")), ("bad_record", F.size(of_record) > 0, F.lit("")),
        ("unequal_records", F.array_sort(F.array_distinct(own)) != periods("values"), F.lit(""))]
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, bad, detail in rules]))
    single = rows.select(key.alias("key"), F.explode(found).alias("v")).select("v.rule", "key", "v.detail")
    repeated = entries.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_identity").alias("rule"), "key", F.lit("").alias("detail"))
    return file_rows.unionByName(single).unionByName(repeated)


def prefixes_met(texts: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """texts joined with every prefix that their text starts with, by equality.

    The lengths that prefixes have are few (a name, a direction and an address): each text is cut at each length and
    the cuts are joined. Lengths are a table of their own, of one row per length.
    """
    lengths = prefixes.select(F.char_length(prefix).alias("_length")).distinct().agg(F.collect_set("_length").alias("_lengths"))
    cut = texts.crossJoin(F.broadcast(lengths)).select(*texts.columns, F.explode("_lengths").alias("_n"))  # one row of lengths
    cut = cut.where(F.col("_n") <= F.char_length(text)).withColumn("_cut", F.expr(f"left(`{text}`, _n)"))
    return cut.join(prefixes, F.col("_cut") == F.col(prefix)).drop("_n", "_cut")


def read_failed(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """The sources that the lines of a failure file name, each once, with the number of their first line.

    A line names a source if it begins with its name, direction and address, a blank after each; a name may hold blanks.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    named = sources.withColumn("_prefix", F.concat(F.concat_ws(" ", "name", "pick", "url"), F.lit(" ")))
    first = prefixes_met(lines, "text", named.select("_prefix"), "_prefix").groupBy("_prefix").agg(F.min("line").alias("line"))
    return named.join(first, "_prefix").drop("_prefix")


def without_repaired(lines: DataFrame, text: str, repaired: DataFrame) -> DataFrame:
    """Lines of a failure file without those that name a source of repaired (name, pick, url)."""
    prefixes = repaired.select(F.concat(F.concat_ws(" ", "name", "pick", "url"), F.lit(" ")).alias("_prefix")).distinct()
    return lines.join(prefixes_met(lines, text, prefixes, "_prefix").select(*lines.columns).distinct(), lines.columns, "left_anti")


def posts(rows: DataFrame, keys: Sequence[str], json: str) -> DataFrame:
    """(keys, place, post columns): the posts of JSON arrays, in order."""
    found = rows.select(*keys, F.posexplode(F.from_json(json, POSTS)).alias("place", "p"))
    return found.select(*keys, "place", "p.id", "p.user_id", "p.draw", "p.topic", "p.content", "p.status", F.col("p.user.nickname").alias("nickname"))


def owned(rows: DataFrame, keys: Sequence[str], expected: str) -> DataFrame:
    """Per key whether all its posts belong to the expected user (an id; an unknown user does not)."""
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("user_id") == F.col(expected), F.lit(False))).alias("owned"), F.count("*").alias("n"))


def with_details(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Posts with the content of their detail (id, topic, content) where that is longer and has the same topic."""
    d = details.select(F.col("id").alias("_id"), F.col("topic").alias("_topic"), F.col("content").alias("_content"))
    better = F.col("topic").eqNullSafe(F.col("_topic")) & (F.char_length("_content") > F.char_length(F.coalesce("content", F.lit(""))))
    return rows.join(d, rows["id"] == d["_id"], "left").withColumn("content", F.when(better, F.col("_content")).otherwise(F.col("content"))).drop("_id", "_topic", "_content")


def snapshot_period(draw: Column, topic: Column) -> Column:
    """The period of a post: its draw if that is one, else the first three-digit number of its topic, else null."""
    number = draw.try_cast("int")
    named = F.regexp_extract(topic, r"(?<!\d)(\d{3})(?!\d)", 1).try_cast("int")
    return F.coalesce(F.when(number.between(1, 365), number), F.when(named.between(1, 365), named))


def exact_posts(rows: DataFrame, keys: Sequence[str], requested: Column, topic: str, nickname: Column) -> DataFrame:
    """(keys, status, place, id): of each key's posts the one of the requested period, or why there is none.

    not_published: no post has the period; conflict: several have; target_missing: its topic, author or state of
    publication is another; field_validation: it has no id above 0; ok.
    """
    mine = F.col("draw").try_cast("long") == requested
    fits = (F.col("status") == "published") & (F.trim(F.coalesce("topic", F.lit(""))) == topic) & F.coalesce(F.col("nickname") == nickname, F.lit(False))
    got = rows.groupBy(*keys).agg(F.count_if(mine).alias("_n"), F.min(F.when(mine, F.struct("place", "id", F.coalesce(fits, F.lit(False)).alias("fits")))).alias("r"))
    status = (
        F.when(F.col("_n") == 0, "not_published").when(F.col("_n") > 1, "conflict").when(~F.col("r.fits"), "target_missing")
        .when(~F.coalesce(F.col("r.id") > 0, F.lit(False)), "field_validation").otherwise("ok"))
    ok = F.col("status") == "ok"
    return got.withColumn("status", status).select(*keys, "status", F.when(ok, F.col("r.place")).alias("place"), F.when(ok, F.col("r.id")).alias("id"))
