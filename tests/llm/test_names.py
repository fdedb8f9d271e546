"""Columns whose names clash with any that the stages use inside pass through them."""

import pytest
from pyspark.sql import functions as F

from strataloom.llm import decontamination, exact_dedup, mixing, set_join

CLASH = ("_id", "_copies", "_copy", "_gone", "_any", "id", "k", "kept", "copies", "keep_id", "class_id", "_ID_", "_sha_", "sha", "spans", "size", "target")


@pytest.mark.parametrize("stage", [exact_dedup.exact_dedup, set_join.jaccard_dedup, mixing.mixed_documents, lambda d: decontamination.decontaminated(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(0))])
def test_clashing_names(spark, stage):
    rows = [(i, f"one two three four five {i} six seven", "s") for i in range(4)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = plain.select("*", *[F.lit(7).alias(c) for c in CLASH])
    got = stage(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in stage(plain).collect())
    assert got.where(" or ".join(f"`{c}` <> 7" for c in CLASH)).count() == 0
