"""Mixing sources to target weights by entropy balancing.

Every document d of source s gets a rate r_d, the point nearest to rate 1 in relative entropy under one
token constraint per source, sum(size_d * r_d) = target_s, and the bound r_d <= cap. Its solution is the
exponential tilt r_d = min(cap, exp(lambda_s * size_d / scale_s)); lambda solves the convex dual by
safeguarded Newton steps. The steps run on the counts per (source, size), each step one join and one
aggregate over that table, never over the documents. Rates are then rounded to whole copies: each document
keeps floor(r) copies and gets one more when a hash of its id falls below the fraction, moved by one offset
per source, found from a histogram of fixed width, and by one document more or less, so that the words taken
meet the target.

Only DataFrame functions are used; nothing is collected but one number per Newton step.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.llm.common import drop_written, free_names, written

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
WEIGHTS = (1, 2, 3)
BINS = 1 << 12
TOLERANCE = 1e-9
MAX_STEPS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, size) -> (k, source, source_size, target): shares by weight, capped, the excess reshared.

    Sources weigh by code point order, null last. The fixed point of resharing is target = min(cap * size,
    mu * weight) with one mu for all; mu follows from running sums over the sources in order of cap * size /
    weight, a table of one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    per = per.withColumn("k", k).withColumn("w", w).withColumn("most", (F.col("source_size") * cap).cast("double"))
    order = W.orderBy(F.col("most") / F.col("w"), "k")
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    mu = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("mu", mu)
    # the first source that is not above its cap sets mu for all that follow; those before it are capped
    first = F.min(F.when(F.col("mu") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), "k", "mu"))).over(every)
    return per.withColumn("level", first["mu"]).select(
        "k", "source", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def _rate(cap: int) -> Column:
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), tilt))


def tilts(hist: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """Newton on the dual: (k, source, source_size, target, scale, full, lam), one row per source."""
    shape = hist.groupBy("k").agg(
        (F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"),
        F.min("size").alias("least"))
    state = targets.join(shape, "k", "left").select(
        "k", "source", "source_size", "target", F.coalesce("scale", F.lit(1.0)).alias("scale"),
        (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"),
        F.lit(-700.0).alias("lo"),
        (F.log(F.lit(float(cap))) * F.col("scale") / F.col("least") + 1.0).alias("hi"),
        F.lit(1.0).alias("gap"),
    )
    state = written(state, "mix-state")
    for _ in range(MAX_STEPS):
        x, r = F.col("size") / F.col("scale"), _rate(cap)
        mass = F.col("n") * F.col("size")
        sums = hist.join(state.where("not full"), "k").groupBy("k").agg(
            F.sum(mass * r).alias("f"), F.sum(F.when(r < cap, mass * x * r).otherwise(0.0)).alias("slope"))
        high = F.col("f") > F.col("target")
        lo, hi = F.when(~high, F.col("lam")).otherwise(F.col("lo")), F.when(high, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.log(F.col("f") / F.col("target")) * F.col("f") / F.col("slope")
        gap = F.abs(F.col("f") / F.col("target") - 1)
        moved = F.when(gap <= TOLERANCE, F.col("lam")).when(
            (F.col("slope") > 0) & (step > F.col("lo2")) & (step < F.col("hi2")), step
        ).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        nxt = state.join(sums, "k", "left").withColumn("lo2", lo).withColumn("hi2", hi).select(
            "k", "source", "source_size", "target", "scale", "full",
            F.when(F.col("f").isNull(), F.col("lam")).otherwise(moved).alias("lam"),
            F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"),
            F.when(F.col("f").isNull(), F.lit(0.0)).otherwise(gap).alias("gap"),
        )
        nxt = written(nxt, "mix-state")
        drop_written(state)
        state = nxt
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            return state
    warnings.warn(f"the mix's dual is not solved to {TOLERANCE} after {MAX_STEPS} steps", stacklevel=2)
    return state


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP,
        weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies, taken.

    size counts the words (null text: 0), taken = size * copies, copies <= cap. The choice of the extra copy
    is a hash of the id, so reruns agree; rows that repeat an id are counted one by one and decided alike. A
    null source is a source of its own. Other columns are ignored, whatever their names. Documents of size 0 get rate 1 and one copy, or cap copies where
    their source is at its cap, and take nothing. An empty table gives no rows.
    """
    sizes = written(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")),
        "mix-sizes")
    targets = written(source_targets(sizes, cap, weights), "mix-targets")
    same = sizes["source"].eqNullSafe(targets["source"])
    hist = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    hist = written(hist.join(targets, hist["source"].eqNullSafe(targets["source"])).select("k", "size", "n"), "mix-sizes-n")
    state = tilts(hist, targets, cap)
    drop_written(hist)
    rates = sizes.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    r = _rate(cap)
    whole = F.floor(r)
    u = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 40)) / float(1 << 40)
    rates = rates.select(
        "id", "source", "size", "k", "source_size", "target", r.alias("rate"), whole.cast("long").alias("whole"),
        F.when(whole < cap, F.floor((u - (r - whole) + 1) * (BINS / 2))).cast("long").alias("bin"))
    # the offset of each source: so many bins get the extra copy that the words taken come nearest to the target
    bins = rates.groupBy("k", "bin").agg(
        F.sum("size").alias("more"), F.sum(F.col("size") * F.col("whole")).alias("sure"), F.first("target").alias("target"))
    by, upto = W.partitionBy("k"), W.partitionBy("k").orderBy(F.col("bin").asc_nulls_first())
    off = F.abs(F.sum("sure").over(by) + F.sum(F.when(F.col("bin").isNull(), 0).otherwise(F.col("more"))).over(upto) - F.col("target"))
    cut = bins.withColumn("off", off).groupBy("k").agg(
        F.min_by(F.coalesce("bin", F.lit(-1)), F.struct("off", F.coalesce("bin", F.lit(-1)))).alias("cut"),
        F.min("off").alias("off"), F.abs(F.sum("sure") - F.max("target")).alias("none"))
    cut = cut.select("k", F.when(F.col("none") < F.col("off"), F.lit(-1)).otherwise(F.col("cut")).alias("cut"))
    rates = rates.join(written(cut, "mix-cut"), "k")
    more = F.coalesce(F.col("bin") <= F.col("cut"), F.lit(False))
    # one document more or less per source, the one that brings it nearest to its target
    gap = rates.groupBy("k").agg((F.first("target") - F.sum(F.col("size") * (F.col("whole") + more.cast("long")))).alias("gap"))
    delta = F.when(more, -F.col("size")).otherwise(F.col("size"))
    turn = rates.join(written(gap, "mix-gap"), "k").where("bin is not null and size > 0").groupBy("k").agg(
        F.min(F.struct(F.abs(F.col("gap") - delta), "id")).alias("best"), F.abs(F.first("gap")).alias("was"))
    turn = turn.where(F.col("best")["col1"] < F.col("was")).select("k", F.col("best")["id"].alias("turned"))
    rates = rates.join(written(turn, "mix-turn"), "k", "left")
    turned = F.coalesce((F.col("id") == F.col("turned")) & F.col("bin").isNotNull(), F.lit(False))
    copies = F.col("whole") + (more != turned).cast("long")
    return rates.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate",
        copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it has copies. Repeated ids must hold equal rows."""
    own, times, copy = free_names(docs, "_id", "_copies", "_copy")
    plan = mix(docs, id_col, text_col, source_col).where("copies > 0").select(F.col(id_col).alias(own), F.col("copies").cast("int").alias(times)).distinct()
    joined = docs.join(plan, F.col(id_col).eqNullSafe(F.col(own)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
