"""Audits over histories: sources that repeat each other, gaps in coverage, sources that always fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUSPICIOUS, DUPLICATE = 3, 6


#: Sources of a group that are compared at once.
BLOCK = 512


def equal_runs(history: DataFrame, source: str, period: str, match: list[str], least: int = SUSPICIOUS) -> DataFrame:
    """Pairs of sources with equal match columns over consecutive periods: the longest run, the newest of equals.

    history has one row of a source and period at most; match columns are scalars. Sources meet on the match columns of
    least consecutive periods at once, so only pairs that have a run of that length meet at all. They bring their whole
    history: a group is cut into blocks, every two blocks are compared by one task, and a pair is told where its first run
    begins, so that no pair is shuffled. start is the newest period of the run, end the oldest.
    """
    kinds = dict(history.dtypes)
    known = history.where(F.col(source).isNotNull() & F.col(period).isNotNull())
    for c in match:
        known = known.where(F.col(c).isNotNull())
    held = [(F.col(c) + F.lit(0.0)).cast(kinds[c]) if kinds[c] in ("float", "double") else F.col(c) for c in match]  # one zero
    names = [f"m{k}" for k in range(len(match))]
    per = known.groupBy(F.col(source).alias("source")).agg(F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), *[c.alias(n) for c, n in zip(held, names)]))).alias("l"))
    whole = lambda i: F.get("l", i + (least - 1))["p"] - F.get("l", i)["p"] == least - 1
    per = per.where(F.size("l") >= least).select("source", "l", F.explode(F.filter(F.sequence(F.lit(0), F.size("l") - least), whole)).alias("i"))
    run = F.transform(F.slice("l", F.col("i") + 1, least), lambda x: x.dropFields("p"))
    keyed = per.select("source", F.get("l", F.col("i"))["p"].alias("at"), F.xxhash64(run).alias("h"), F.col("l.p").alias("p"), *[F.col(f"l.{n}").alias(n) for n in names])
    w = W.partitionBy("at", "h")
    met = keyed.withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("source")) - 1).where("n > 1")
    block, last = F.floor(F.col("place") / BLOCK), F.floor((F.col("n") - 1) / BLOCK)
    tiles = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    tiles = tiles.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("n", "other")
    of = kinds[source]
    found = tiles.groupBy("at", "h", "x", "y").applyInArrow(_longest(names, least), f"first {of}, second {of}, consecutive long, start long, end long")
    return found.select(
        "first", "second", "consecutive", F.col("start").cast(kinds[period]).alias("start"), F.col("end").cast(kinds[period]).alias("end"),
        F.when(F.col("consecutive") >= DUPLICATE, "duplicate").otherwise("suspicious").alias("classification"))


def _longest(names: list[str], least: int):
    """Of a tile the pairs whose first run begins at the tile's period, each with its longest run, the newest of equals."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("place").combine_chunks()
        flat = lambda c: pc.list_flatten(t[c]).combine_chunks()
        periods = flat("p").to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(t)), pc.list_value_length(t["p"]).to_numpy())
        axis, column = np.unique(periods, return_inverse=True)
        code = np.zeros(len(periods), np.int64)
        for n in names:
            value = flat(n).dictionary_encode()
            _, code = np.unique(code * len(value.dictionary) + value.indices.to_numpy(), return_inverse=True)
        values = np.full((len(axis), len(t)), -1, np.int32)
        values[column, row] = code
        block = t["block"].to_numpy()
        left, right = np.flatnonzero(block == t["x"][0].as_py()), np.flatnonzero(block == t["y"][0].as_py())
        shape, kind = (len(left), len(right)), np.int16 if len(axis) < 1 << 15 else np.int32
        length, best, end, first = (np.zeros(shape, kind) for _ in range(4))  # end and first: places of the axis, from 1
        for k, own in enumerate(values):
            a, b = own[left][:, None], own[right][None, :]
            if k and axis[k] != axis[k - 1] + 1:
                length[:] = 0
            length += 1
            length *= (a == b) & (a >= 0)
            first[(length == least) & (first == 0)] = k + 1
            newer = (length >= least) & (length >= best)
            np.copyto(best, length, where=newer)
            np.copyto(end, kind(k + 1), where=newer)
        begins = int(np.searchsorted(axis, t["at"][0].as_py())) + least
        told = first == begins
        if t["x"][0] == t["y"][0]:
            told &= np.arange(shape[0])[:, None] < np.arange(shape[1])[None, :]
        i, j = np.nonzero(told)
        n, newest = best[i, j].astype(np.int64), axis[end[i, j] - 1]
        who = t["source"].combine_chunks()
        return pa.table({"first": who.take(pa.array(left[i])), "second": who.take(pa.array(right[j])), "consecutive": n, "start": newest, "end": newest - n + 1})

    return compare


def _unions(n: int, least: int) -> dict[tuple[int, ...], int]:
    """Of n places the unions of runs of least places, with their signs in the count of what has one run at least (inclusion and exclusion)."""
    signs = {frozenset(): -1}
    for i in range(n - least + 1):
        run, grown = frozenset(range(i, i + least)), dict(signs)
        for places, c in signs.items():
            grown[places | run] = grown.get(places | run, 0) - c
        signs = {k: c for k, c in grown.items() if c}
    return {tuple(sorted(k)): c for k, c in signs.items() if k}


def run_counts(history: DataFrame, source: str, period: str, match: list[str], periods: list[int]) -> DataFrame:
    """One row: n_duplicate, n_suspicious, the numbers of pairs that equal_runs() gives, without any pair as a row.

    history has one row of a source and period at most; periods are consecutive. A pair that agrees in some periods falls into
    one group by the values of these, so sizes of groups give the numbers of pairs, and those of unions of runs the number
    of pairs with a run. The rows grow with the sources; their factor grows with the periods (for ten: a few dozen).
    """
    held = F.struct(*match)
    known = history.where(F.col(period).isin(periods))
    for c in match:
        known = known.where(F.col(c).isNotNull())
    per = known.groupBy(source).agg(F.array(*[F.max(F.when(F.col(period) == p, held)) for p in periods]).alias("_v"))
    short, long = _unions(len(periods), SUSPICIOUS), _unions(len(periods), DUPLICATE)
    sets = [(places, short.get(places, 0), long.get(places, 0)) for places in sorted(short.keys() | long.keys())]
    made = [F.struct(F.lit(k).alias("set"), F.lit(a).alias("short"), F.lit(b).alias("long"), F.array(*[F.get("_v", F.lit(i)) for i in places]).alias("v")) for k, (places, a, b) in enumerate(sets)]
    rows = per.select(F.explode(F.array(*made)).alias("x")).select("x.*").where(F.forall("v", lambda x: x.isNotNull()))
    sizes = rows.groupBy("set", "short", "long", "v").agg(F.count("*").alias("n")).where("n > 1")
    pairs = F.expr("n * (n - 1) div 2")
    some, six = (F.coalesce(F.sum(pairs * F.col(c)), F.lit(0).cast("long")) for c in ("short", "long"))
    return sizes.agg(six.alias("n_duplicate"), (some - six).alias("n_suspicious"))


def incomplete(rows: DataFrame, source: str, period: str, expected: int) -> DataFrame:
    """Sources with fewer distinct periods than expected."""
    return rows.groupBy(source).agg(F.count_distinct(period).alias("n_periods")).where(F.col("n_periods") < expected)


def failed_in_all(results: DataFrame, keys: list[str], ok: Column, n_periods: int) -> DataFrame:
    """Sources whose results of all periods have failed."""
    return results.groupBy(*keys).agg(F.bool_and(~ok).alias("_failed"), F.count("*").alias("n")).where(F.col("_failed") & (F.col("n") == n_periods)).drop("_failed")


def success_gate(results: DataFrame, keys: list[str], ok: Column, percent: int = 85) -> DataFrame:
    """Groups whose share of successes is strictly above the percentage, in whole numbers."""
    got = results.groupBy(*keys).agg(F.count_if(ok).alias("n_ok"), F.count("*").alias("n"))
    return got.where(F.col("n_ok") * 100 > F.col("n") * percent)


#: What an audit as a whole comes to.
CLEAN, SUSPECT, FAILED = 0, 1, 2


def verdict(sources: DataFrame, history: DataFrame, findings: DataFrame, source: str, period: str, expected: int) -> DataFrame:
    """One row: code, n_missing, n_incomplete, n_duplicate, n_suspicious of the coverage and the equal runs, which are findings, together.

    FAILED if a source has no row of the history, or fewer periods than expected, or equals another for DUPLICATE periods;
    SUSPECT if only shorter equal runs are found; else CLEAN.
    """
    runs = findings.agg(F.count_if(F.col("classification") == "duplicate").alias("n_duplicate"), F.count_if(F.col("classification") == "suspicious").alias("n_suspicious"))
    return verdict_of_counts(sources, history, runs, source, period, expected)


def verdict_of_counts(sources: DataFrame, history: DataFrame, runs: DataFrame, source: str, period: str, expected: int) -> DataFrame:
    """As verdict(), of the numbers of equal runs, as run_counts() gives them."""
    per = history.groupBy(source).agg(F.count_distinct(period).alias("_n"))
    gaps = sources.select(source).distinct().join(per, source, "left").agg(
        F.count_if(F.col("_n").isNull()).alias("n_missing"), F.count_if(F.col("_n") < expected).alias("n_incomplete"))
    code = F.when((F.col("n_missing") > 0) | (F.col("n_incomplete") > 0) | (F.col("n_duplicate") > 0), FAILED).when(F.col("n_suspicious") > 0, SUSPECT).otherwise(CLEAN)
    return gaps.crossJoin(runs).select(code.alias("code"), "n_missing", "n_incomplete", "n_duplicate", "n_suspicious")  # one row each
