"""From raw documents to encoded training data: five stages, each over all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import exact_dedup, mixing, pieces, set_join
from strataloom.llm import toxicity as tox
from strataloom.llm.common import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that score 0.5 or more, learning from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    weights = tox.fit(docs, labels.where(~tox.held_out(F.col("doc_id"))))
    return tox.clean(docs, weights)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of linked documents the one with the smallest doc_id."""
    return set_join.jaccard_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target has it: no row, one, or up to three."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the digest of the text that they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(docs, model, decoded=True, digest=True)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("jaccard join", jaccard), ("source mix", mix), ("sentencepiece", encode)]

#: The learned stage and the merges of the encoding are not expressible in SQL; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of the mix: the stages one after the other, each from the table before.

    Null texts count as empty ones: never toxic by themselves, one of them stays, links with nothing, taken as the mix
    has documents without words, encoded to no ids. Rows that repeat an id are judged one by one, but all rows of an id
    stay where one does, so equal ids should have equal rows; documents of a null id stay or go like others. Columns
    beyond those of documents pass through all stages but the last. An empty table gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
