import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from strataloom.llm import language_model as lm
from strataloom.llm import queries
from tests.llm.conftest import odd_rows


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def check_base(rows, got):
    counts = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_query_base_and_held_out_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = queries.op1_lm_score(spark, "/root/testdata/sf0.01").collect()
    check_base(rows, got)
    own = [r for r in got if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own) + 0.03 * sum(r.n_tokens for r in own)


def test_odd_rows_and_rare_words(odd, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 20)  # nearly all words go through the join
    check_base([(i, t) for i, t, _ in odd_rows()], lm.scored(odd).collect())


def test_probabilities_sum_to_one(odd):
    """Over all tokens of the training rows and the unknown token of each class."""
    model = lm.fit(odd)
    rows = model.counts.collect()
    mass = np.zeros(lm.CLASSES)
    for r in rows:
        cls = lm._classes(np.array([r.h], np.int64).view(np.uint64), np.array([r["shape"]]), model.frequent)[0]
        mass[cls] += r.c + 0.5 if lm.FREQUENT <= cls < lm.END_CLASS else 1
    shapes = slice(lm.FREQUENT, lm.END_CLASS)
    assert np.allclose(mass[shapes] + 0.5, 10 ** model.norm[shapes])
    assert np.allclose(mass[np.r_[: lm.FREQUENT, lm.END_CLASS]], 1)


def recomputed(text, model, counts):
    """log10 probability of a text, token by token."""
    words = [*(text or "").encode().lower().split(), None]
    texts = pa.array([text or ""])
    (_, _, buf, offs), = lm.tk.byte_slices(texts)
    h, shape, begin = lm._tokens(buf, offs)
    assert len(h) == len(words)
    past = [int(lm.START + np.uint64(b)) for b in (1, 2, 3)]
    out = 0.0
    for i, (w, x, kind) in enumerate(zip(words, h, shape)):
        back = [int(h[i - b]) if i >= b else past[b - 1] for b in (1, 2, 3)]
        mult, mod = int(lm.tk.MULT), 1 << 64
        mix = lambda v: int(lm.tk.mix(np.array([v % mod], np.uint64))[0])
        keys = [p * mult + k + 1 for k, p in enumerate(back)] + [back[0] * mult + mix(back[1])]
        slots = len(model.weights) - 1
        z = sum(model.weights[mix(k) >> (65 - slots.bit_length())].astype(float) for k in keys) + model.weights[-1]
        cls = lm._classes(np.array([x]), np.array([kind]), model.frequent)[0]
        out += (z[cls] - np.log(np.exp(z - z.max()).sum()) - z.max()) / np.log(10)
        if lm.FREQUENT <= cls < lm.END_CLASS:
            out += math.log10(counts.get(int(x.astype(np.int64)), 0) + 0.5) - model.norm[cls]
    return out


def test_scores_recomputed(odd, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 20)
    model = lm.fit(odd)
    counts = {r.h: r.c for r in model.counts.collect()}
    texts = {repr(i): t for i, t, _ in odd_rows() if len(t or "") < 2000}
    got = [r for r in lm.score(odd, model).collect() if repr(r.doc_id) in texts and r.n_tokens < 400 and r.doc_id is not None]
    assert len(got) > 20
    for r in got:
        assert abs(r.score - recomputed(texts[repr(r.doc_id)], model, counts)) < 1e-3 * max(1, abs(r.score))


def test_other_cores_give_the_same_scores(spark, odd):
    first = sorted((repr(r.doc_id), r.score) for r in lm.scored(odd).collect())
    again = sorted((repr(r.doc_id), r.score) for r in lm.scored(odd.repartition(7)).collect())
    assert [n for n, _ in first] == [n for n, _ in again] and np.allclose([s for _, s in first], [s for _, s in again], rtol=1e-6)


def test_no_training_rows(odd, none):
    model = lm.fit(none)
    ends = [r for r in lm.score(odd, model).collect() if r.n_tokens == 1]
    assert ends and all(abs(r.score - math.log10(1 / lm.CLASSES)) < 1e-6 for r in ends)


def test_empty_table(none):
    assert lm.scored(none).collect() == []
