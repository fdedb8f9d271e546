"""Document sets of a source: the boundaries between their documents, pairs of heading and body, one verdict from both.

docs: (source, document, url, record_id, own_record_id, parent_url, link_reference, identity_inherited, text), document
naming a row within its source; '' is unknown. sources: (source, name, keywords, url, payload, pattern, allowed,
expected), pattern being that of linked documents and expected the record that all documents must be of.

A document is linked by another if one of the ways to write its address is among the references of the other's text.
References are extracted once per document and meet the addresses by an equi-join within the source, so no text is
searched for another's address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import payload as pl
from strataloom.functions import urls
from strataloom.functions.text import decode_entities
from strataloom.schema import JOIN_MARK

#: References of a text: addresses, quoted or assigned values, and paths from the root.
REFERENCE = r"""(?i)(?:https?:)?//[^\s"'<>()\\]+|(?<=["'=(])[^\s"'<>()\\]+|(?<![\w/:.])/[^\s"'<>()\\]+"""


def references(text: Column) -> Column:
    """The different references of a text, escaped slashes and character references decoded."""
    return F.array_distinct(F.regexp_extract_all(decode_entities(F.replace(text, F.lit("\\/"), F.lit("/"))), F.lit(REFERENCE), F.lit(0)))


def forms(url: Column, parent_url: Column, link_reference: Column) -> Column:
    """The ways in which a document at parent_url may write an address."""
    path, query = urls.path(url), urls.query(url)
    relative = F.when(query != "", F.concat(path, F.lit("?"), query)).otherwise(path)
    netloc = F.regexp_replace(urls.authority(url), r"^[^/]*", "")
    plain = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    own = decode_entities(F.replace(link_reference, F.lit("\\/"), F.lit("/")))
    written = F.when(urls.resolved(parent_url, own) == url, own)
    short = F.concat(netloc, relative)
    same = F.lower(urls.authority(url)) == F.lower(urls.authority(parent_url))
    near = F.when(same, F.array(relative, plain(relative), F.when(query == "", path))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(written, url, plain(url), short, plain(short)), near)
    return F.array_distinct(F.filter(every, lambda f: f.isNotNull() & ~f.isin("", "/", "//")))


def _links(anchors: DataFrame, bodies: DataFrame) -> DataFrame:
    """(source, anchor, body): bodies whose parent_url is the anchor's url and that the anchor's text refers to."""
    told = anchors.select("source", F.col("document").alias("anchor"), F.col("url").alias("parent_url"), F.explode(references(F.col("text"))).alias("token"))
    named = bodies.where("parent_url <> '' and url <> '' and url <> parent_url").select(
        "source", "parent_url", F.col("document").alias("body"), F.explode(forms(F.col("url"), F.col("parent_url"), F.col("link_reference"))).alias("token"))
    return told.join(named, ["source", "parent_url", "token"]).where("anchor <> body").select("source", "anchor", "body").distinct()


def violations(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, document, rule), one row per document and rule that it breaks; the set is accepted if there are none.

    unbound, mismatched: not of the expected record. own_id: its own record is not that of its address. record: nor is
    the record that it is taken for. evidence: an inherited identity without parent and reference. reference: a parent
    without a reference. parent: no other document has the parent's address. parent_record: its record is none of the
    parents'. link: no parent refers to it.
    """
    d = docs.join(sources.select("source", "expected"), "source", "left")
    named = urls.record_identity(F.col("url"))
    own = F.when(named != "", named).otherwise(F.col("own_record_id"))
    has, child, reached = F.col("record_id") != "", F.col("parent_url") != "", F.col("link_reference") != ""
    broken = F.array(
        F.when((F.coalesce("expected", F.lit("")) != "") & ~has, "unbound"),
        F.when((F.coalesce("expected", F.lit("")) != "") & has & (F.col("record_id") != F.col("expected")), "mismatched"),
        F.when((F.col("own_record_id") != "") & (named != "") & (F.col("own_record_id") != named), "own_id"),
        F.when((own != "") & has & (own != F.col("record_id")) & (own != F.concat(F.lit("admin_article:"), F.col("record_id"))), "record"),
        F.when(F.col("identity_inherited") & (~child | ~reached), "evidence"), F.when(child & ~reached, "reference"))
    alone = d.select("source", "document", F.explode(F.array_compact(broken)).alias("rule"))
    children = docs.where(child).select("source", "document", "url", "parent_url", "link_reference", "record_id")
    parents = docs.where("url <> ''").select("source", F.col("url").alias("parent_url"), F.col("document").alias("_parent"), F.col("record_id").alias("_record"))
    met = children.join(parents, ["source", "parent_url"]).where("_parent <> document").groupBy("source", "document").agg(
        F.collect_set(F.when(F.col("_record") != "", F.col("_record"))).alias("_records"))
    orphans = children.join(met, ["source", "document"], "left_anti").select("source", "document", F.lit("parent").alias("rule"))
    foreign = children.where(has).join(met, ["source", "document"]).where((F.size("_records") > 0) & ~F.array_contains("_records", F.col("record_id")))
    linked = _links(docs, docs).select("source", F.col("body").alias("document"))
    loose = children.where("url <> parent_url").join(met, ["source", "document"], "left_semi").join(linked, ["source", "document"], "left_anti")
    return alone.unionByName(orphans).unionByName(foreign.select("source", "document", F.lit("parent_record").alias("rule"))).unionByName(
        loose.select("source", "document", F.lit("link").alias("rule")))


def merged_by_address(docs: DataFrame) -> DataFrame:
    """The documents of one source and address put together, where there are several and they do not name two records; same columns."""
    some = lambda c: F.coalesce(F.min(F.when(F.col(c) != "", F.col(c))), F.lit(""))
    got = docs.where("url <> ''").groupBy("source", "url").agg(
        F.array_sort(F.collect_list(F.struct("document", "text"))).alias("l"), F.count_distinct(F.when(F.col("record_id") != "", F.col("record_id"))).alias("_records"),
        some("record_id").alias("record_id"), some("own_record_id").alias("own_record_id"), some("parent_url").alias("parent_url"), some("link_reference").alias("link_reference"),
        F.bool_or("identity_inherited").alias("identity_inherited"))
    got = got.where("size(l) > 1 and _records <= 1")
    return got.select(
        "source", F.array_join(F.transform("l", lambda x: x["document"]), "+").alias("document"), "url", "record_id", "own_record_id", "parent_url", "link_reference",
        "identity_inherited", F.array_join(F.transform("l", lambda x: x["text"]), JOIN_MARK).alias("text"))


def linked_pairs(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, document, url, record_id, status, text, body_start): headings with the bodies that they may prove.

    An anchor is a document, or all of an address, whose text has the source's name or a keyword. A body is proved by an
    anchor that links it, if it is of the anchor's origin, of the pattern, of an allowed origin or a data script; or by
    one with the same parent if both are of the pattern. status is record_conflict if the two name different records.
    Places before body_start are the anchor's.
    """
    every = docs.select("source", "document", "url", "record_id", "own_record_id", "parent_url", "link_reference", "identity_inherited", "text")
    every = every.unionByName(merged_by_address(docs))
    known = sources.select("source", "name", "keywords", "payload", "pattern", "allowed")
    owns = F.contains("text", F.col("name")) | F.exists("keywords", lambda k: F.contains(F.col("text"), k))
    anchors = every.join(known, "source").where(owns).select(*every.columns)
    bodies = docs.where("link_reference <> '' and parent_url <> ''")
    fits = lambda url: (F.coalesce("pattern", F.lit("")) != "") & F.coalesce(F.rlike(url, F.concat(F.lit("(?i)^(?:"), F.col("pattern"), F.lit(")"))), F.lit(False))
    a = anchors.select("source", F.col("document").alias("anchor"), F.col("url").alias("a_url"), F.col("parent_url").alias("a_parent"), F.col("link_reference").alias("a_link"))
    b = bodies.select("source", F.col("document").alias("body"), F.col("url").alias("b_url"), F.col("parent_url").alias("b_parent"))
    direct = _links(anchors, bodies).join(a, ["source", "anchor"]).join(b, ["source", "body"]).join(known, "source")
    origin = urls.origin(F.col("b_url"))
    near = F.lower(urls.authority(F.col("a_url"))) == F.lower(urls.authority(F.col("b_url")))
    may = near | fits(F.col("b_url")) | F.array_contains(F.transform("allowed", urls.origin), origin) | pl.is_data_script(F.col("b_url"), F.col("payload"))
    direct = direct.where(F.coalesce(may, F.lit(False)))
    siblings = a.where("a_parent <> '' and a_link <> ''").withColumn("b_parent", F.col("a_parent")).join(b, ["source", "b_parent"]).join(known, "source")
    siblings = siblings.where((F.col("anchor") != F.col("body")) & fits(F.col("a_url")) & fits(F.col("b_url")))
    pairs = direct.select("source", "anchor", "body").unionByName(siblings.select("source", "anchor", "body")).distinct()
    left = anchors.select("source", F.col("document").alias("anchor"), F.col("text").alias("_a"), F.col("record_id").alias("_ar"))
    right = bodies.select("source", F.col("document").alias("body"), F.col("text").alias("_b"), F.col("record_id").alias("_br"), "url")
    both = pairs.join(left, ["source", "anchor"]).join(right, ["source", "body"])
    clash = (F.col("_ar") != "") & (F.col("_br") != "") & (F.col("_ar") != F.col("_br"))
    return both.select(
        "source", F.concat_ws("+", "anchor", "body").alias("document"), "url", F.when(F.col("_ar") != "", F.col("_ar")).otherwise(F.col("_br")).alias("record_id"),
        F.when(clash, "record_conflict").otherwise("ok").alias("status"), F.concat("_a", F.lit(JOIN_MARK), "_b").alias("text"),
        (F.char_length("_a") + len(JOIN_MARK)).alias("body_start"))


def pair_consensus(single: DataFrame, paired: DataFrame, docs: DataFrame, pairs: DataFrame, sources: DataFrame, requested: list[int]) -> DataFrame:
    """(source, requested, status, value, position, carrier, how, n_single, n_paired, records): one verdict per source and period.

    single and paired are the choices of period.by_document() in documents and in pairs. conflict: a document or pair
    contradicts itself or another of its kind, documents and pairs have different sets of values, or the rows name several
    records; record_conflict: a pair joins two records. ok takes the value of the documents (how = single), or that of the
    pairs where no document has one (how = paired); its carrier is the first by: at the source's own address, address,
    document, place. Else the mildest failure, or no_rows.
    """
    kinds = single.withColumn("how", F.lit("single")).unionByName(paired.withColumn("how", F.lit("paired")))
    where = docs.select("source", "document", "url").unionByName(pairs.select("source", "document", "url")).dropDuplicates(["source", "document"])
    kinds = kinds.join(where, ["source", "document"], "left").join(sources.select("source", F.col("url").alias("_home")), "source", "left")
    ok, is_single = F.col("status") == "ok", F.col("how") == "single"
    rank = F.when(F.col("status") == "not_found", 1).when(F.col("status") == "out_of_reach", 2).otherwise(3)
    order = F.struct((F.col("url") != F.col("_home")).alias("away"), "url", "document", "position", "value")
    values = lambda cond: F.array_sort(F.collect_set(F.when(ok & cond, F.col("value"))))  # noqa: E731  a conflict if there are two
    got = kinds.groupBy("source", "requested").agg(
        F.count_if(ok & is_single).alias("n_single"), F.count_if(ok & ~is_single).alias("n_paired"), values(is_single).alias("_single"), values(~is_single).alias("_paired"),
        F.bool_or(F.col("status") == "conflict").alias("_conflict"), F.min_by("status", rank).alias("_failure"),
        F.min(F.when(ok & is_single, order)).alias("_s"), F.min(F.when(ok & ~is_single, order)).alias("_p"),
        F.array_sort(F.collect_set(F.when(ok & (F.col("record_id") != ""), F.col("record_id")))).alias("records"))
    torn = pairs.where("status = 'record_conflict'").select("source").distinct().withColumn("_torn", F.lit(True))
    every = sources.select("source").withColumn("requested", F.explode(F.array(*map(F.lit, requested))))
    out = every.join(got, ["source", "requested"], "left").join(torn, "source", "left")
    both = (F.size("_single") > 0) & (F.size("_paired") > 0) & (F.col("_single") != F.col("_paired"))
    status = (
        F.when(F.col("_torn"), "record_conflict").when(F.col("_failure").isNull(), "no_rows")
        .when(F.col("_conflict") | (F.size("_single") > 1) | (F.size("_paired") > 1) | both | (F.size("records") > 1), "conflict")
        .when((F.col("n_single") > 0) | (F.col("n_paired") > 0), "ok").otherwise(F.col("_failure")))
    carrier, good = F.coalesce("_s", "_p"), F.col("status") == "ok"
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.withColumn("status", status).select(
        "source", "requested", "status", *[F.when(good, carrier[c]).alias(c) for c in ("value", "position")], F.when(good, carrier["document"]).alias("carrier"),
        F.when(good, F.when(F.col("n_single") > 0, "single").otherwise("paired")).alias("how"), zero("n_single"), zero("n_paired"),
        F.coalesce("records", F.array().cast("array<string>")).alias("records"))
