"""The queries of this subpackage, with production parameters over whole tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import decontamination, embedding_dedup
from strataloom.llm import exact_dedup as exact
from strataloom.llm import html_text, language_model, mixing, pieces, prefix_trie, set_join, suffix_dedup
from strataloom.llm import token_store
from strataloom.llm import toxicity as tox
from strataloom.llm import vector_codes
from strataloom.llm.common import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_store.write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_ids(spark, path, digest=True)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded=True, digest=True)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tox.toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")).select(
        "doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score", "n_offending")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("spans")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))[0]


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_source_mix": op2_source_mix,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_token_ids": op5_token_ids,
    "op6_html_text": op6_html_text,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_decontamination": op12_decontamination,
    "op13_vector_codes": op13_vector_codes,
}

#: A-Z to a-z only, as the operators lower-case.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words of the benchmark comparison.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: CRC-32 of the decimal digits of c, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                lambda r, b: xor(r >> 8, list_reduce(list_prepend(xor(r, b) & 255, range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))))"""


def _rounds(n: int) -> str:
    """Steps b1 to bn of the codebooks: every part goes to its nearest entry, entries become floors of means."""
    return ",".join(f"""
        a{k} AS MATERIALIZED (
            SELECT vec_id, p, x, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e := e)) AS best
            FROM parts JOIN b{k} USING (p) GROUP BY vec_id, p, x),
        m{k} AS (
            SELECT p, e, list(mean ORDER BY i) AS c FROM (
                SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*)) AS mean FROM a{k}, range(1, 17) AS t(i) GROUP BY ALL) GROUP BY p, e),
        b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))""" for k in range(n))


ORACLE = {
    "op8_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256({LOW}) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY {LOW})""",
    "op11_prefix_trie": f"""
        WITH turn AS (
            SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        conv AS (SELECT c, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, sha256(text)) AS w, {CRC} % 6 AS h FROM turn GROUP BY c),
        made AS (SELECT a.c, list_concat(coalesce(b.w[1 : a.h], []), a.w[a.h + 1 :]) AS w FROM conv AS a LEFT JOIN conv AS b ON b.c = a.c - a.c % 100),
        path AS (SELECT c, d, w[1 : d] AS p, d = len(w) AS ends, CASE WHEN d = 0 THEN 0 ELSE length(w[d].t) END AS chars FROM made, range(len(w) + 1) AS t(d)),
        node AS MATERIALIZED (
            SELECT p, d, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM path GROUP BY p, d),
        child AS MATERIALIZED (SELECT a.p, a.d, count(b.d) AS n_children FROM node AS a LEFT JOIN node AS b ON b.d = a.d + 1 AND b.p[1 : b.d - 1] = a.p GROUP BY a.p, a.d),
        up AS (SELECT p, d, unnest(range(d + 1)) AS k, n, chars, n_children FROM node JOIN child USING (p, d)),
        sums AS (SELECT p[1 : k] AS p, sum((n - 1) * chars)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY p[1 : k])
        SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n AS n_convs, n_children, n_leaves, saved_tokens, a.ends_sha256
        FROM node AS a JOIN child USING (p, d) JOIN sums USING (p) LEFT JOIN node AS b ON b.d = a.d - 1 AND b.p = a.p[1 : a.d - 1]""",
    "op12_decontamination": f"""
        WITH doc AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOW}, '{WORD}') AS w FROM documents),
        item AS MATERIALIZED (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({LOW}, '{WORD}') AS w FROM benchmark) WHERE len(w) > 0),
        windows AS MATERIALIZED (SELECT DISTINCT item_id, n, w[k : k + n - 1] AS x FROM item, range(1, len(w) - n + 2) AS t(k)),
        found AS MATERIALIZED (
            SELECT r, k, d.n, d.x FROM (SELECT r, k, n, w[k : k + n - 1] AS x FROM doc, (SELECT DISTINCT n FROM item), range(1, len(w) - n + 2) AS t(k)) AS d
            WHERE x IN (SELECT x FROM windows)),
        hit AS (SELECT r, count(DISTINCT k + i) AS n_hit FROM found, range(0, n) AS t(i) GROUP BY r),
        named AS (
            SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
            FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM found JOIN windows USING (n, x) WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op13_vector_codes": f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT vec_id, p, v[p * 16 + 1 : p * 16 + 16] AS x FROM kept, range(4) AS t(p)),
        b0 AS MATERIALIZED (
            SELECT p, row_number() OVER w - 1 AS e, x AS c FROM parts WINDOW w AS (PARTITION BY p ORDER BY vec_id) QUALIFY row_number() OVER w <= 256),
        {_rounds(4)},
        last AS (
            SELECT vec_id, p, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e := e)) AS best
            FROM parts JOIN b4 USING (p) GROUP BY vec_id, p),
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY vec_id),
        books AS (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b4, range(1, 17) AS t(i))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (vec_id), books""",
}
