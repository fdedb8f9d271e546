"""Table schemas and the alphabet of the reference configuration."""

from __future__ import annotations

from pyspark.sql import types as T

# The symbols of a value, in rank order, and the suffix of a period.
SYMBOLS = "牛马羊鸡狗猪鼠虎兔龙蛇猴"
PERIOD_SUFFIX = "期"
LAST_PERIOD = 365
#: Between the documents of a joined source.
JOIN_MARK = "\n" + "#" * 512 + "\n"

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SOURCES = _struct(
    name=_S, pick=_S, url=_S, parser=_S, title=_S, record=_S, stop=_S, payload=_S, api_url=_S, keywords=T.ArrayType(_S), profile_id=_S,
    linked_document_pattern=_S, allowed_redirect_origins=T.ArrayType(_S), allowed_document_origins=T.ArrayType(_S), allow_invalid_certificate=_B,
    strict_block=_B, detail_enrich=_B)
DOCUMENTS = _struct(
    source_id=_S, doc_ord=_I, label=_S, url=_S, source=_S, record_id=_S, parent_url=_S, link_reference=_S, own_record_id=_S, parent_record_id=_S,
    identity_inherited=_B, scan_complete=_B)
CANDIDATES = _struct(source_id=_S, doc_ord=_I, period=_I, value=_S, open_result=_S, raw=_S, position=_I)
HISTORY = _struct(source_id=_S, period=_I, value=_S, position=_I)
