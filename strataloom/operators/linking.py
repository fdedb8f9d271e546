"""Documents and their relations: content dedupe, consensus, links, containment, boundaries, reachability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.text import bound
from strataloom.sources.scratch import written


def first_by_content(docs: DataFrame, keys: Sequence[str], content: str, order: str) -> DataFrame:
    """Of rows with equal keys and content the first, with the content's digest and the number of copies."""
    digest = docs.withColumn("digest", F.sha2(content, 256))
    rest = [c for c in docs.columns if c not in (*keys, content)]
    out = digest.groupBy(*keys, "digest").agg(F.min_by(F.struct(*rest, content), order).alias("row"), F.count("*").alias("copies"))
    return out.select(*keys, "row.*", "digest", "copies")


def consensus(docs: DataFrame, keys: Sequence[str], value: str, carrier_order: Column) -> DataFrame:
    """Per group whether all documents agree on one value, and the first document in carrier order."""
    got = docs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(value).alias("values"), F.min(carrier_order).alias("carrier"))
    return got.withColumn("status", F.when(F.col("values") > 1, "conflict").otherwise("agreed"))


def boundaries(docs: DataFrame, keys: Sequence[str], identity: str, complete: Column) -> DataFrame:
    """A document set is accepted if its scan is complete and all its documents carry one identity."""
    got = docs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(identity).alias("identities"), F.bool_and(complete).alias("_complete"))
    status = F.when(~F.col("_complete"), "incomplete_scan").when(F.col("identities") > 1, "identity_conflict").otherwise("ok")
    return got.withColumn("status", status).drop("_complete")


def top_links(pages: DataFrame, key: str, html: str, most: int, score=None) -> DataFrame:
    """The first links of each page, once each, by score (higher first) and then by place.

    score: a function from the link's column to a number, such as one for data scripts before others.
    """
    parts = [F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""), F.lit(k)) for k in (1, 2, 3)]
    link = F.zip_with(F.zip_with(parts[0], parts[1], lambda x, y: F.concat(x, y)), parts[2], lambda x, y: F.concat(x, y))
    found = pages.select(key, F.posexplode(link).alias("place", "link"))
    found = found.groupBy(key, "link").agg(F.min("place").alias("place"))
    by = ([score(F.col("link")).desc()] if score is not None else []) + [F.col("place")]
    return found.withColumn("slot", F.row_number().over(W.partitionBy(key).orderBy(*by))).where(F.col("slot") <= most).select(key, "link", "slot")


#: A side of so many narrow rows at most, some 32 MB, may be sent to every executor.
SENT_ROWS = 500_000


def sent_if_small(table: DataFrame) -> DataFrame:
    """A table with a broadcast hint if its row count allows it; else it is shuffled. The count is a job of its own."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


#: Words of the keys of long and of other passages, and characters of those of short ones at most.
LONG_KEY, KEY, CHARACTERS = 8, 3, 3


def _runs(parts: Column, n: int, between: str) -> Column:
    """Hashes of all runs of n elements of an array of strings; parts is computed once."""
    def of(b: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(b) - n + 1, F.lit(1)))
        return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(b, i, n), between))))

    return bound(parts, of)


def containing(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """(doc_id, item_id) of texts that contain a passage, by an equi-join on what must then be there.

    A text with the passage also has a run of the passage's inner words between spaces, from its second word on: LONG_KEY
    words of a long passage, as they are rarer, KEY words of another. One with a passage of few words has its first
    characters, CHARACTERS at most. A text is split once for each kind of key that the passages have, and its hashes
    travel with the ids alone; pairs that meet are joined with the texts and searched, so a false meeting costs time
    only. Hashes of passages are sent where they are few; else both sides are shuffled, and a key of very many texts is
    split by the adaptive join. Empty passages are in every text, null ones in none, and null texts contain nothing.
    """
    d = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).where("_t is not null")
    i = items.select(F.col(item_id).alias("_i"), F.col(passage).alias("_p")).where("_p is not null").withColumn("_w", F.split("_p", " "))
    n, chars = F.size("_w"), F.least(F.char_length("_p"), F.lit(CHARACTERS))
    kind = F.when(n >= LONG_KEY + 2, LONG_KEY).when(n >= KEY + 2, KEY).otherwise(-chars)  # words, or characters below 0
    key = F.when(kind > 0, F.xxhash64(F.array_join(F.slice("_w", F.lit(2), kind), " "))).otherwise(F.xxhash64(F.substring(F.col("_p"), F.lit(1), -kind)))
    keyed = i.select("_i", "_p", kind.alias("_kind"), F.when(n >= KEY + 2, F.xxhash64(F.array_join(F.slice("_w", F.lit(2), F.greatest(kind, F.lit(1))), " "))).otherwise(key).alias("_k"))
    pairs = None
    for size in sorted(r[0] for r in keyed.select("_kind").distinct().collect()):  # five kinds at most
        own = keyed.where(F.col("_kind") == size)
        if size == 0:
            met = d.select("_d", F.explode(F.array(F.xxhash64(F.lit("")))).alias("_k"))
        elif size > 0:
            met = d.select("_d", F.explode(_runs(F.split("_t", " "), size, " ")).alias("_k"))
        else:
            met = d.select("_d", F.explode(_runs(F.split("_t", ""), -size, "")).alias("_k"))
        met = met.join(sent_if_small(own.select("_i", "_k")), "_k").select("_d", "_i")
        pairs = met if pairs is None else pairs.unionByName(met)
    if pairs is None:
        return d.join(i, F.lit(False)).select(F.col("_d").alias(doc_id), F.col("_i").alias(item_id))
    hits = pairs.distinct().join(i.select("_i", "_p"), "_i").join(d, "_d").where(F.contains("_t", "_p"))
    return hits.select(F.col("_d").alias(doc_id), F.col("_i").alias(item_id)).distinct()


def reachable(links: DataFrame, starts: DataFrame, node: str, most: int) -> DataFrame:
    """(node, depth): nodes within so many links of the starts, at their smallest depth. links: (parent, child).

    A level has only nodes that no level before had, so cycles are not walked again; levels are written, each once.
    """
    seen = written(starts.select(F.col(node).alias("node"), F.lit(0).alias("depth")).distinct(), "reach-level")
    level = seen
    for depth in range(1, most + 1):
        further = level.join(links, level["node"] == links["parent"]).select(F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        level = written(further.join(seen.select("node"), "node", "left_anti"), "reach-level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.groupBy("node").agg(F.min("depth").alias("depth"))
