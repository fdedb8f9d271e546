"""Row extraction by pattern banks: all matches of several patterns, with code-point offsets, once each."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.operators import patterns as pt
from strataloom.schema import SYMBOLS


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A Python pattern with named groups for Java, and the numbers of its named groups."""
    names = dict(re.compile(pattern).groupindex)
    return "(?U)" + pattern.replace("(?P<", "(?<").replace("(?P=", "\\k<"), names


def _ordered(text: Column, bank: Sequence[tuple[str, tuple[int, ...]]]) -> Column:
    """array<struct<offset, pattern_ord, g0, g1, ...>> of the matches of all patterns, in this order."""
    names = [f"g{i}" for i in range(len(bank[0][1]))]

    def numbered(k: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["offset"].alias("offset"), F.lit(k).alias("pattern_ord"), *[m[c].alias(c) for c in names]))

    return F.array_sort(F.flatten(F.array(*[numbered(k, tx.matches(text, p, groups)) for k, (p, groups) in enumerate(bank)])))


def _once(rows: Column, most: int, same) -> Column:
    """Rows in order of offset without those that equal one before at the same offset, of which there are most at most."""
    bound = F.transform(F.array(rows), lambda every: F.filter(every, lambda x, i: ~F.exists(
        F.slice(every, F.greatest(i - most, F.lit(0)) + 1, F.least(i, F.lit(most))), lambda y: (x["offset"] == y["offset"]) & same(x, y))))
    return F.element_at(bound, 1)


def bank_matches(docs: DataFrame, keys: Sequence[str], text: str, bank: Sequence[tuple[str, tuple[int, ...]]]) -> DataFrame:
    """(keys, offset, g0, g1, ..., pattern_ord): matches of every pattern, those with equal offset and groups once.

    bank: (pattern, groups to take); of equal matches the first pattern in bank order stays. Equal matches are in
    one text, so they are found in its array: one pass over the texts and no exchange.
    """
    names = [f"g{i}" for i in range(len(bank[0][1]))]

    def same(x: Column, y: Column) -> Column:
        out = F.lit(True)
        for c in names:
            out = out & x[c].eqNullSafe(y[c])
        return out

    rows = _once(_ordered(F.col(text), bank), len(bank) - 1, same)
    return docs.select(*keys, F.explode_outer(rows).alias("m")).where("m is not null").select(*keys, "m.offset", *[f"m.{c}" for c in names], "m.pattern_ord")


def bank_rows(text: Column, base: Column, patterns: Sequence[str] = pt.BANK, alphabet: str = SYMBOLS, semantic: bool = True) -> Column:
    """array<struct<position, period, value, open_result, raw, valid, pattern_ord>> of patterns with groups period, zodiac and open.

    A value is two different symbols of the alphabet after separators are dropped; rows without one are left out, as
    are, if semantic, rows whose text has no word of the meaning or the author's, and rows of the grammar's recognisers
    whose words no rule accepts. Of rows with the same place, period
    and value the first pattern in order stays.
    """
    bank = []
    for p in patterns:
        java, names = java_pattern(p)
        bank.append((java, (names["period"], names["zodiac"], names["open"], 0, names.get("lead", 0), names.get("tail", 0))))
    judged = patterns is pt.BANK

    def row(m: Column) -> Column:
        digits = F.translate(m["g0"], "０１２３４５６７８９", "0123456789")
        return F.struct(m["offset"].alias("offset"), digits.try_cast("int").alias("period"), tx.clean_value(m["g1"]).alias("value"),
                        m["g2"].alias("open_result"), m["g3"].alias("raw"), m["pattern_ord"].alias("pattern_ord"), m["g4"].alias("lead"), m["g5"].alias("tail"))

    def good(r: Column) -> Column:
        fits = r["value"].rlike(f"^[{alphabet}]{{2}}$") & r["period"].between(1, 365)
        fits = fits & pt.accepted(r["lead"], r["tail"]) if judged else fits
        return fits & r["raw"].rlike("(?U)" + pt.SEMANTIC) & ~F.contains(r["raw"], F.lit(pt.AUTHOR)) if semantic else fits

    rows = F.filter(F.transform(_ordered(text, bank), row), good)
    rows = _once(rows, len(bank) - 1, lambda x, y: (x["period"] == y["period"]) & (x["value"] == y["value"]))
    return F.transform(rows, lambda r: F.struct(
        (base + r["offset"]).alias("position"), r["period"].alias("period"), r["value"].alias("value"), r["open_result"].alias("open_result"),
        r["raw"].alias("raw"), F.lit(True).alias("valid"), r["pattern_ord"].alias("pattern_ord")))


def candidates(docs: DataFrame, keys: Sequence[str], text: str, patterns: Sequence[str], alphabet: str) -> DataFrame:
    """(keys, position, period, value, open_result, raw, pattern_ord) of patterns with groups period, zodiac and open: bank_rows as rows."""
    rows = bank_rows(F.col(text), F.lit(0), patterns, alphabet, semantic=False)
    return docs.select(*keys, F.explode_outer(rows).alias("m")).where("m is not null").select(
        *keys, "m.position", "m.period", "m.value", "m.open_result", "m.raw", "m.pattern_ord")
