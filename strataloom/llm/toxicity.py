"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut at . ! ? and line ends). A sentence has probability
p = sigmoid(bias + sum of the weights of its distinct telling words); the document's score is their noisy-or,
1 - prod(1 - p). Weights are learned from document labels alone, by full-batch gradient steps whose gradients
are summed on the executors; the sentence probabilities then point at the offending sentences.

The classifier is fitted on a bounded sample: of the labelled rows that may be learned from, a share of
FIT_ROWS over their number, chosen by a hash of doc_id. Scores depend on the text alone. Telling words are
found by counts per 64-bit hash in the sample and known by it, so no word has another word's weight.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm import textkit as tk
from strataloom.llm.common import drop_written, vector_sum, written

#: Tables of weights without keys are indexed by so many bits of the hash.
BITS = 16
DIM = 1 << BITS
#: About so many labelled rows are learned from at most.
FIT_ROWS = 20_000
#: A word gets a weight if it is in so many bags of the sample at least, and in more toxic ones than its share
#: by so many standard deviations.
MIN_BAGS = 5
LEAST_Z = 5.0
STEPS = 40
RATE = 0.4
#: What holds weights near zero, in bags: as much as this part of one bag with the word, however many bags are learned from, so that a word
#: of few bags that are all toxic is not outweighed in large samples.
PRIOR = 0.05
START = -7.0
#: Letters, digits, and all bytes of non-ASCII characters make up words; everything else separates them.
APART = np.ones(256, dtype=bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    APART[_low:_high] = False
STOP = np.zeros(256, dtype=bool)
STOP[[ord(c) for c in ".!?\n\r"]] = True
SCHEMA = "score double, worst_start int, worst_end int, worst_score double, n_sentences int, n_offending int"


class Model(NamedTuple):
    """Sorted hashes of the telling words, and their weights with the bias in the last place."""

    keys: np.ndarray
    weights: np.ndarray


def _taken(model) -> tuple[np.ndarray | None, np.ndarray]:
    return model if isinstance(model, Model) else (None, np.asarray(model))


def held_out(id_col: Column, fold: int = 0, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == fold


def bags(buf: np.ndarray, offs: np.ndarray, known: np.ndarray | None = None):
    """Sentences and their words: (feature of each word, sentence of each word, sentence's text, word spans).

    Only sentences with a word count; words repeated in a sentence count once. Given the sorted hashes of the
    known words, features are places there, and other words have none.
    """
    starts, ends, first = tk.word_bounds(buf, offs, APART)
    n_docs = len(offs) - 1
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    h = tk.word_hashes(buf, starts, ends)
    stops = np.concatenate([[0], np.cumsum(STOP[buf])])
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (stops[starts[1:]] != stops[starts[:-1]]) | (doc[1:] != doc[:-1])
    sent = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(starts)]]) - 1
    if known is None:
        feature, dim = (h >> np.uint64(64 - BITS)).astype(np.int64), DIM
    else:
        feature, dim = np.searchsorted(known, h), len(known) + 1
        held = np.append(known, np.uint64(0))[feature] == h
        held &= feature < len(known)
        feature, sent = feature[held], sent[held]
    keys = np.unique(sent * dim + feature)
    return keys % dim, keys // dim, doc[heads], starts[heads], ends[tails]


def _features(batches, known: np.ndarray | None = None):
    """(doc_id, text, toxic) -> one row per slice: labels, sentences per bag, words per sentence, features."""
    for b in batches:
        toxic = b.column("toxic").to_numpy(zero_copy_only=False)
        for i, j, buf, offs in tk.byte_slices(b.column("text"), tk.SMALL_SLICE):
            f, s, d, _, _ = bags(buf, offs, known)
            yield pa.record_batch(
                [pa.array([x.tobytes()], pa.binary()) for x in (
                    toxic[i:j].astype(np.int8), np.bincount(d, minlength=j - i).astype(np.int32),
                    np.bincount(s, minlength=len(d)).astype(np.int32), f.astype(np.int32))],
                names=["y", "bags", "sentences", "features"])


def _unpack(b: pa.RecordBatch, k: int):
    y, n, w, f = (np.frombuffer(b.column(c)[k].as_py(), t) for c, t in (("y", np.int8), ("bags", np.int32), ("sentences", np.int32), ("features", np.int32)))
    return y, np.repeat(np.arange(len(y)), n), np.repeat(np.arange(len(w)), w), len(w), f


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _gradient(weights: np.ndarray):
    """Of the log loss; the last three places hold the bias, the loss and the number of bags."""

    dim = len(weights) - 1

    def part(batches):
        g = np.zeros(dim + 3)
        for b in batches:
            for k in range(b.num_rows):
                y, doc, sent, n_sent, f = _unpack(b, k)
                z = weights[dim] + np.bincount(sent, weights[f], minlength=n_sent)
                a = np.bincount(doc, softplus(z), minlength=len(y))
                a = np.maximum(a, 1e-12)
                da = np.where(y == 1, -1 / np.expm1(np.minimum(a, 500)), 1.0)
                dz = da[doc] / (1 + np.exp(-z))
                g[:dim] += np.bincount(f, dz[sent], minlength=dim)
                g[dim] += dz.sum()
                g[dim + 1] += np.where(y == 1, -np.log(-np.expm1(-a)), a).sum()
                g[dim + 2] += len(y)
        return g

    return part


def _word_counts(batches):
    """(text, toxic) -> (h, n, hit): bags with each word and toxic bags with it, combined slice by slice."""
    for b in batches:
        toxic = b.column("toxic").to_numpy(zero_copy_only=False)
        for i, j, buf, offs in tk.byte_slices(b.column("text"), tk.SMALL_SLICE):
            starts, ends, first = tk.word_bounds(buf, offs, APART)
            if not len(starts):
                continue
            h, doc = tk.word_hashes(buf, starts, ends), np.repeat(np.arange(j - i), np.diff(first))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            word, at = np.unique(h[new], return_inverse=True)
            hit = np.bincount(at, toxic[i:j][doc[new]], minlength=len(word))
            yield pa.record_batch(
                [pa.array(word.view(np.int64)), pa.array(np.bincount(at).astype(np.int64)), pa.array(hit.astype(np.int64))], names=["h", "n", "hit"])


def telling(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the words of (text, toxic) that stand in toxic bags far more often than chance has it."""
    bags_, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    share = (toxic or 0) / max(bags_, 1)
    n, hit = F.col("n"), F.col("hit")
    words = sample.mapInArrow(_word_counts, "h long, n long, hit long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    kept = words.where((n >= MIN_BAGS) & (hit - n * share >= LEAST_Z * F.sqrt(n * share * (1 - share)) + 1e-9)).select("h").collect()
    return np.sort(np.array([r.h for r in kept], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = FIT_ROWS, steps: int = STEPS) -> Model:
    """The telling words, their weights and the bias. Without a labelled row: all documents clean.

    labels: (doc_id, toxic); rows whose id or label is null are left out, of repeated ids the largest label
    holds. The sample stays on the executors; telling words, weights and gradient are bounded by its size.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    n = known.count()
    if not n:
        return Model(np.zeros(0, np.uint64), np.array([START]))
    share = min(1.0, fit_rows / n)
    known = known.where(F.pmod(F.xxhash64(F.lit(29), id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select(id_col, F.col(text_col).alias("text")).join(known, id_col).select("text", "toxic")
    texts = written(sample.withColumn("toxic", F.col("toxic").cast("int")), "toxicity-texts")
    keys = telling(texts)
    dim = len(keys)
    sample = written(texts.mapInArrow(
        lambda batches: _features(batches, keys), "y binary, bags binary, sentences binary, features binary"), "toxicity-sample")
    weights = np.append(np.zeros(dim), START)
    m, v = np.zeros(dim + 1), np.zeros(dim + 1)
    for t in range(1, steps + 1):
        g = vector_sum(sample, _gradient(weights), dim + 3)
        total = max(g[dim + 2], 1.0)
        g = g[: dim + 1] / total
        g[:dim] += PRIOR * weights[:dim] / total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    drop_written(texts, sample)
    return Model(keys, weights)


def score(docs: DataFrame, weights: np.ndarray | Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, score, and its worst sentence as byte offsets (-1, -1 where there is no sentence).

    n_offending sentences reach 0.5. Null and empty texts have no sentence and score 0. Repeated rows are
    scored one by one; an empty table gives no rows. Whole texts are read, slice by slice.
    """
    keys, weights = _taken(weights)

    def run(batches):
        for b in batches:
            n = b.num_rows
            a, worst, count, bad = np.zeros(n), np.full((n, 2), -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
            top = np.zeros(n)
            for i, j, buf, offs in tk.byte_slices(b.column("text"), tk.SMALL_SLICE):
                f, s, d, lo, hi = bags(buf, offs, keys)
                if not len(d):
                    continue
                z = weights[-1] + np.bincount(s, weights[f], minlength=len(d))
                a[i:j] = np.bincount(d, softplus(z), minlength=j - i)
                count[i:j] = np.bincount(d, minlength=j - i)
                bad[i:j] = np.bincount(d[z >= 0], minlength=j - i)
                order = np.lexsort((np.arange(len(d)), -z, d))
                firsts = order[np.concatenate([[True], d[order][1:] != d[order][:-1]])]
                rows = i + d[firsts]
                worst[rows, 0], worst[rows, 1] = lo[firsts] - offs[d[firsts]], hi[firsts] - offs[d[firsts]]
                top[rows] = 1 / (1 + np.exp(-z[firsts]))
            yield pa.record_batch(
                [b.column("id"), pa.array(-np.expm1(-a)), pa.array(worst[:, 0]), pa.array(worst[:, 1]), pa.array(top), pa.array(count), pa.array(bad)],
                names=[id_col, *[x.split()[0] for x in SCHEMA.split(", ")]])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, {SCHEMA}")


def offending_sentences(docs: DataFrame, weights: np.ndarray | Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, sentence, score) of every sentence that reaches least, by byte offsets in the text."""
    keys, weights = _taken(weights)

    def run(batches):
        for b in batches:
            ids = b.column("id")
            for i, _, buf, offs in tk.byte_slices(b.column("text"), tk.SMALL_SLICE):
                f, s, d, lo, hi = bags(buf, offs, keys)
                z = weights[-1] + np.bincount(s, weights[f], minlength=len(d)) if len(d) else np.zeros(0)
                p = 1 / (1 + np.exp(-z))
                hit = np.flatnonzero(p >= least)
                raw = buf.tobytes()
                yield pa.record_batch(
                    [ids.take(pa.array(i + d[hit])), pa.array(lo[hit] - offs[d[hit]], pa.int64()), pa.array(hi[hit] - offs[d[hit]], pa.int64()),
                     pa.array([raw[x:y].decode() for x, y in zip(lo[hit], hi[hit])], pa.string()), pa.array(p[hit], pa.float64())],
                    names=[id_col, "start", "end", "sentence", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, start long, end long, sentence string, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out and score all: id, held_out, score, predicted, worst sentence."""
    weights = fit(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col)
    return score(docs, weights, id_col, text_col).withColumns(
        {"held_out": F.coalesce(held_out(F.col(id_col)), F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")})


def clean(docs: DataFrame, weights: np.ndarray | Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below least, all columns kept: one narrow pass."""
    keys, weights = _taken(weights)

    def run(batches):
        for b in batches:
            a = np.zeros(b.num_rows)
            for i, j, buf, offs in tk.byte_slices(b.column(text_col), tk.SMALL_SLICE):
                f, s, d, _, _ = bags(buf, offs, keys)
                if len(d):
                    a[i:j] = np.bincount(d, softplus(weights[-1] + np.bincount(s, weights[f], minlength=len(d))), minlength=j - i)
            yield b.filter(pa.array(-np.expm1(-a) < least))

    return docs.mapInArrow(run, docs.schema)
