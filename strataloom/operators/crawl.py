"""Closure over captured documents: what a source's page leads to, level by level, within budgets; listings with pages.

captured: (url, text) of every document that has been captured, by its address. A level joins the addresses that the
level before refers to with the captures, after those that the source has already are taken out; each level is written,
so cyclic links end and a level's work is its new documents alone. Levels end by themselves or by their limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions import payload as pl
from strataloom.functions import text as tx
from strataloom.functions import urls
from strataloom.sources.scratch import dropped, written

#: Documents of a source, documents that one document leads to, and levels of frames below a page.
MOST, NESTED, LEVELS = 96, 12, 3
#: Pages of a listing, unless its caller has other limits or none.
LISTING_PAGES = 32
FRAME = r"""(?i)<iframe[^>]+src=["']([^"']+)["']"""
SCRIPT = r"""(?i)<script[^>]+src=["']([^"']+)["']"""


def frames(text: Column) -> Column:
    """The references of a document's frames, in order."""
    return F.regexp_extract_all(tx.decode_entities(F.replace(F.replace(text, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))), F.lit(FRAME), F.lit(1))


def scripts(text: Column) -> Column:
    """The references of a document's scripts, those with data before others, else in order."""
    found = F.regexp_extract_all(text, F.lit(SCRIPT), F.lit(1))
    data = lambda s: F.contains(F.lower(s), F.lit("/upload/script/"))
    return F.concat(F.filter(found, data), F.filter(found, lambda s: ~data(s)))


def closure(sources: DataFrame, captured: DataFrame, references: Callable[[Column], Column] = frames, levels: int = LEVELS, most: int = MOST, nested: int = NESTED) -> tuple[DataFrame, DataFrame]:
    """(documents, scans). documents: source, place, depth, url, parent_url, link_reference, record_id, identity_inherited, text.

    sources: source, url, allowed (origins), api, pattern. The source's own address is at depth 0. References are
    followed to addresses that may_follow() allows and whose own record, if they name one, is that of the source; a
    document that names none inherits it. Each address is taken once, from the first document that refers to it by level,
    place and order. Documents of a level are placed by their parent's place and their order; beyond most documents of a
    source or nested of a parent none are taken. scans: source, n_documents, scan_complete: false if a budget has left
    an address out, an allowed address has not been captured or is empty, or the last level refers to more.
    """
    pages = captured.where(F.coalesce("text", F.lit("")) != "").select(F.col("url").alias("_url"), "text")
    first = sources.join(pages, F.col("url") == F.col("_url"), "left").drop("_url")
    empty = F.lit("")
    root = first.select(
        "source", F.lit(1).alias("place"), F.lit(0).alias("depth"), "url", empty.alias("parent_url"), empty.alias("link_reference"), urls.record_identity(F.col("url")).alias("record_id"),
        F.lit(False).alias("identity_inherited"), "text")
    level = written(root.where("text is not null"), "crawl-level")
    lost = written(root.where("text is null").select("source"), "crawl-lost")
    every, missed, seen, made = level, lost, level.select("source", "url"), []
    rules = sources.select("source", "allowed", "api", "pattern", F.col("url").alias("_root"))
    for depth in range(1, levels + 2):
        told = level.select("source", F.col("place").alias("_place"), F.col("url").alias("parent_url"), F.col("record_id").alias("_record"), F.posexplode(references(F.col("text"))).alias("_nth", "link_reference"))
        told = told.withColumn("url", urls.without_fragment(urls.resolved(F.col("parent_url"), F.col("link_reference")))).join(rules, "source")
        may = pl.may_follow(F.col("url"), F.col("parent_url"), F.col("allowed"), F.col("api"), F.col("pattern"))
        named = urls.record_identity(F.col("url"))
        same = (F.col("_record") == "") | (named == "") | (named == F.col("_record"))
        new = told.where(F.coalesce(may & same, F.lit(False))).join(seen, ["source", "url"], "left_anti")
        # of each address the first reference; then the budgets, by order
        new = new.groupBy("source", "url").agg(F.min(F.struct("_place", "_nth", "parent_url", "link_reference", "_record")).alias("r")).select("source", "url", "r.*")
        if depth > levels:
            beyond = written(new.select("source").distinct(), "crawl-lost")
            missed = missed.unionByName(beyond)
            made.append(beyond)
            break
        have = every.groupBy("source").agg(F.max("place").alias("_have"))
        own = F.row_number().over(W.partitionBy("source", "_place").orderBy("_nth"))
        new = new.withColumn("_own", own).join(pages, F.col("url") == F.col("_url"), "left").join(have, "source")
        taken = (F.col("_own") <= nested) & F.col("text").isNotNull()
        new = new.withColumn("_good", taken).withColumn("_order", F.row_number().over(W.partitionBy("source", "_good").orderBy("_place", "_nth")))
        new = new.withColumn("place", F.col("_have") + F.col("_order")).withColumn("_in", F.col("_good") & (F.col("place") <= most)).drop("_url")
        new = written(new.withColumn("record_id", F.when(urls.record_identity(F.col("url")) != "", urls.record_identity(F.col("url"))).otherwise(F.col("_record"))), "crawl-level")
        made.append(new)
        missed = missed.unionByName(new.where("not _in").select("source"))
        level = new.where("_in").select(
            "source", "place", F.lit(depth).alias("depth"), "url", "parent_url", "link_reference", "record_id", (urls.record_identity(F.col("url")) == "").alias("identity_inherited"), "text")
        every, seen = every.unionByName(level), seen.unionByName(new.select("source", "url"))
        if level.isEmpty():
            break
    scans = sources.select("source").join(every.groupBy("source").agg(F.count("*").alias("n_documents")), "source", "left").join(missed.distinct().withColumn("_lost", F.lit(True)), "source", "left")
    scans = scans.select("source", F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"), F.col("_lost").isNull().alias("scan_complete"))
    out = written(every, "crawl-documents"), written(scans, "crawl-scans")
    dropped(*[t for t in (lost, *made) if t.inputFiles()])
    return out


ANCHOR = r"""(?is)<a\b[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>"""
NEXT = "下一页"


def listing_links(text: Column) -> Column:
    """array<struct<href, title>> of a listing's links, without empty ones and those to nowhere."""
    href, body = F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(2))
    both = F.zip_with(href, body, lambda h, t: F.struct(F.trim(tx.decode_entities(h)).alias("href"), tx.visible_text(t).alias("title")))
    return F.filter(both, lambda x: ~x["href"].isin("", "#"))


def _dealt(table: DataFrame) -> DataFrame:
    """A side of a join that is shuffled: addresses are so few bytes in a file that Spark would send very many of them to every executor."""
    return table.hint("merge")


def chains(starts: DataFrame, following: DataFrame, most: int | None = None) -> DataFrame:
    """source, url, page: the addresses that a source's chain reads, each once and numbered from 1; with most, those up to it and one beyond at least.

    starts: source, url. following: url, next; an address once, next is null where a chain ends. A round leads twice as far as the
    one before, so a chain of n pages takes log2(n) rounds; only sources whose last round has found new addresses all through go on.
    """
    every, ahead, span, made = written(starts.select("source", "url", F.lit(1).alias("page")), "listing-chain"), following.where("next is not null"), 1, []
    going = every.select("source")
    while most is None or span <= most:
        here = every.join(_dealt(going), "source", "left_semi").join(_dealt(ahead), "url")
        new = here.groupBy("source", F.col("next").alias("url")).agg(F.min(F.col("page") + span).alias("page")).join(_dealt(every), ["source", "url"], "left_anti")
        new = written(new.select(*every.columns), "listing-chain")
        every, going, span = every.unionByName(new), new.where(F.col("page") == 2 * span).select("source"), 2 * span
        if going.isEmpty():
            break
        then = ahead.select(F.col("url").alias("next"), F.col("next").alias("_then"))
        ahead = written(ahead.join(_dealt(then), "next").select("url", F.col("_then").alias("next")), "listing-ahead")
        made.append(ahead)
    dropped(*made)
    return every


def listing(sources: DataFrame, captured: DataFrame, markers: list[str], most: int | None = LISTING_PAGES) -> tuple[DataFrame, DataFrame]:
    """(entries, listings) of listings whose pages lead from one to the next. entries: source, place, page, period, url, title.

    sources: source, url, title (a pattern, or empty), name, keywords. The chain of a source goes on with a page's first
    link that is named NEXT and stays on the listing's own path; it ends at an address that the source has read already.
    An entry is a link whose title names a period and is the source's (listing_matches()); of one address the first
    counts. listings: source, n_pages, status: ok, too_long where the chain goes on after most pages (never where most is
    None), or lost where a page of it is not captured; entries of a listing that is not ok are left out.
    """
    pages = captured.where(F.coalesce("text", F.lit("")) != "").select("url", listing_links(F.col("text")).alias("links"))  # a column, as what is named often would be computed as often
    same = lambda u: (F.lower(urls.authority(u)) == F.lower(urls.authority(F.col("url")))) & (F.lower(urls.path(u)) == F.lower(urls.path(F.col("url"))))
    further = F.filter(F.transform(F.filter("links", lambda x: F.contains(x["title"], F.lit(NEXT))), lambda x: urls.resolved(F.col("url"), x["href"])), same)
    pages = written(pages.select("url", "links", urls.without_fragment(F.get(further, F.lit(0))).alias("next")), "listing-page")
    following = written(pages.groupBy("url").agg(F.min("next").alias("next")), "listing-next")
    chain = chains(sources, following, most)
    within = F.lit(True) if most is None else F.col("page") <= most
    found = chain.join(_dealt(following.select("url", F.lit(True).alias("_there"))), "url", "left").groupBy("source").agg(
        F.count_if(within).alias("n_pages"), F.bool_or(within & F.col("_there").isNull()).alias("_lost"), F.bool_or(~within).alias("_long"))
    status = F.when(F.col("_lost"), "lost").when(F.col("_long"), "too_long").otherwise("ok")
    listings = written(found.select("source", "n_pages", status.alias("status")), "listings")
    # what a page's links are by themselves is told before the sources that read the page are known
    links = pages.select(F.col("url").alias("_base"), F.posexplode("links").alias("_nth", "x"))
    links = links.select("_base", "_nth", urls.without_fragment(urls.resolved(F.col("_base"), F.col("x.href"))).alias("url"), F.col("x.title").alias("title"))
    links = links.withColumn("period", F.regexp_extract("title", r"(?<![0-9])([0-9]{3})\s*期", 1).try_cast("int")).where(F.col("period").between(1, 365))
    rules = sources.select("source", F.col("title").alias("_pattern"), "name", "keywords")
    own = chain.where(within).join(_dealt(listings.where("status = 'ok'")), "source", "left_semi").join(_dealt(rules), "source").withColumnRenamed("url", "_base")
    rows = own.join(_dealt(links), "_base").where(pl.listing_matches(F.col("title"), F.col("_pattern"), F.col("name"), F.col("keywords"), markers))
    first = rows.repartition("source").groupBy("source", "url").agg(F.min(F.struct("page", "_nth", "period", "title")).alias("r")).select("source", "url", "r.*")
    place = F.row_number().over(W.partitionBy("source").orderBy("page", "_nth"))
    entries = written(first.select("source", place.alias("place"), "page", "period", "url", "title"), "listing-entries")
    dropped(pages, following, chain)
    return entries, listings


def listing_targets(entries: DataFrame, sources: DataFrame, requested: int | list[int], size: int = 3) -> DataFrame:
    """Entries of the requested periods among the first (top) or last (bottom) few of their source: the window comes before the period."""
    e = entries.join(_dealt(sources.select("source", "pick")), "source")
    inward = F.when(F.col("pick") == "top", F.col("place")).otherwise(-F.col("place"))
    window = e.withColumn("slot", F.row_number().over(W.partitionBy("source").orderBy(inward))).where(F.col("slot") <= size)
    return window.where(F.col("period").isin(requested)).select(*entries.columns, "slot")
