import re
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import sentencepiece

from tests.llm import test_exact_dedup, test_mixing, test_set_join


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [[(r.doc_id, r.text, r.source) for r in docs.collect()]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, sf), f"test-{k}")
        if k < 4:
            assert docs.columns == columns
            seen.append([(r.doc_id, r.text, r.source) for r in docs.collect()])
    raw, clean, single, apart, mixed = seen
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {i for i, _, _ in raw} - {i for i, _, _ in clean}
    assert sum(labels.get(i) == 0 for i in gone) <= 0.05 * sum(v == 0 for v in labels.values())
    kept = {r[0] for r in map(eval, test_exact_dedup.brute(clean)) if r[3]}
    assert {i for i, _, _ in single} == kept
    assert {i for i, _, _ in apart} == {c for _, c, _ in map(eval, test_set_join.brute(single))}
    target, taken = test_mixing.brute_targets(apart), defaultdict(int)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s in mixed:
        taken[s] += size(t)
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(size(x) for _, x, y in apart if y == s)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = docs.collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((i, tuple(library.encode(t or ""))) for i, t, _ in mixed)


def test_stages_handle_odd_rows_and_empty_tables(spark, odd, none, sf):
    """Nulls, empty and long texts, repeated rows and clashing columns pass through every stage."""
    from tests.llm.conftest import odd_rows

    for docs, rows in ((odd, odd_rows()), (none, [])):
        ids = {i for i, _, _ in rows}
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.written(stage(spark, docs, sf), f"odd-{k}")
            got = docs.collect()
            assert {r.doc_id for r in got} <= ids and (got or not rows)
            assert docs.columns == (odd.columns if k < 4 else ["doc_id", "n_tokens", "ids", "decoded_sha256"])
