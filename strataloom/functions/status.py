"""Failure taxonomy and strict decoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_base64(text: Column) -> Column:
    """UTF-8 text of a base64 string; null unless every character belongs to it and the bytes are valid UTF-8."""
    bare = F.regexp_replace(text, r"\s+", "")
    good = bare.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (bare != "")
    return F.when(good, F.try_validate_utf8(F.try_to_binary(bare, F.lit("base64")).cast("string")))


def category(message: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The class of the first rule whose pattern a message holds."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rules:
        out = out.when(message.rlike(pattern), name)
    return out.otherwise(otherwise)


def retryable(status: Column) -> Column:
    """Client errors that another attempt cannot mend are final."""
    return ~status.isin(400, 401, 403, 404, 410)
