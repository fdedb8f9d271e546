"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A text is its words (textkit) and one end token. Each token has a class: the FREQUENT commonest tokens and
the end are classes of their own, all others fall into SHAPES classes by a hash of their last two bytes, which
unseen words have as well. P(token | history) = P(class | history) * P(token | class):

* P(class | history) is a softmax over classes; its weights are the sum of the rows of one hashed table for
  the previous token, the two skip tokens before it, and the pair of the last two (ORDERS features). They are
  trained by gradient steps: each shard of documents runs Adagrad over its minibatches in order, the shards' weights
  are averaged by tokens on the executors, and the next round starts from the mean; every training document is
  used in exactly one of ROUNDS rounds. A shard sends its weights once, however many partitions its rows are dealt over. The table grows with the training tokens up to a size that may be sent;
  shards grow in number with them.
* P(token | class) is a softmax of log(count + 0.5) over the class's tokens and one unknown token, from counts
  over all training documents.

So the model is proper in the same sense as the base, add-half smoothing of single tokens. Counts of the
KNOWN commonest tokens, a table of fixed size, go to every task; all other tokens of a document are joined
with the full table of counts. Tokens are told apart by a 64-bit hash.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.llm import textkit as tk
from strataloom.llm.common import scaled_sum, written

FREQUENT = 12
SHAPES = 19
CLASSES = FREQUENT + SHAPES + 1
END_CLASS = CLASSES - 1
#: Rows of the hashed table, a power of two: one for so many training tokens, within these bounds (32 classes of
#: float32 each, 8 MB at most, so that it may go to every task).
TOKENS_PER_SLOT, LEAST_SLOTS, MOST_SLOTS = 512, 1 << 13, 1 << 16
#: Training tokens of a shard. Shards follow from the documents alone, so that any cluster learns the same weights.
SHARD_TOKENS = 4_000_000
ORDERS = 4
ROUNDS = 2
RATE = 0.3
#: Adagrad starts from this sum of squares, which keeps rows that are seen rarely near zero.
POWER = 10.0
MINIBATCH = 4096
KNOWN = 200_000
END = np.uint64(0x5E9D5E9D5E9D5E9D)
START = np.uint64(0x57A257A257A257A2)
FOLDS, HELD = 5, 1


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of all tokens, an end after each text, and where each text's tokens begin."""
    starts, ends, first = tk.word_bounds(buf, offs)
    n_docs = len(offs) - 1
    h = np.full(len(starts) + n_docs, END, np.uint64)
    shape = np.zeros(len(h), np.int64)
    begin = first + np.arange(n_docs + 1)
    at = np.arange(len(starts)) + np.repeat(np.arange(n_docs), np.diff(first))
    if len(starts):
        h[at] = tk.word_hashes(buf, starts, ends)
        last, before = tk.LOWER[buf[ends - 1]].astype(np.uint64), tk.LOWER[buf[np.maximum(ends - 2, starts)]].astype(np.uint64)
        shape[at] = (tk.mix(last * np.uint64(256) + before) % np.uint64(SHAPES)).astype(np.int64)
    return h, shape, begin


def _count(batches):
    """Texts -> (h, shape, n), combined over the task as far as memory allows."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        h, s, n = (np.concatenate(c) for c in zip(*held))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        return u, s[first], np.bincount(back, n).astype(np.int64)

    def rows(got):
        for i in range(0, len(got[0]), 1 << 16):
            h, s, n = (c[i : i + (1 << 16)] for c in got)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n)], names=["h", "shape", "n"])

    for b in batches:
        for _, _, buf, offs in tk.byte_slices(b.column("text")):
            h, s, _ = _tokens(buf, offs)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, s[first], n))
            if sum(len(x[0]) for x in held) > 1_500_000:
                held = [merged()]
                if len(held[0][0]) > 750_000:
                    yield from rows(held.pop())
    if held:
        yield from rows(merged())


def _lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def _classes(h: np.ndarray, shape: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    at = _lookup(frequent, h)
    return np.where(at >= 0, at, np.where(h == END, END_CLASS, FREQUENT + shape))


def _features(h: np.ndarray, begin: np.ndarray, slots: int) -> np.ndarray:
    """Rows of the hashed table for every token, ORDERS per token."""
    place = np.arange(len(h)) - np.repeat(begin[:-1], np.diff(begin))
    past = []
    for back in (1, 2, 3):
        p = np.full(len(h), START)
        p[back:] = h[:-back] if len(h) > back else h[:0]
        p[place < back] = START + np.uint64(back)
        past.append(p)
    keys = [p * tk.MULT + np.uint64(i + 1) for i, p in enumerate(past)] + [past[0] * tk.MULT + tk.mix(past[1])]
    return np.stack([(tk.mix(k) >> np.uint64(65 - slots.bit_length())).astype(np.int32) for k in keys], axis=1)


def _logits(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = w[f[:, 0]]
    for j in range(1, ORDERS):
        z += w[f[:, j]]
    z += w[-1]
    return z


def _shards(batches):
    """Batches in order of their shard -> (shard, its batches)."""
    pieces = (b.slice(i, j - i) for b in batches for i, j in _runs(b.column("shard").to_numpy()))
    return groupby(pieces, lambda b: b.column("shard")[0].as_py())


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


def _train(weights: np.ndarray, frequent: np.ndarray):
    """Of each shard its place, its tokens and the weights that it comes to, with a one behind them (so that sums count the tokens)."""

    def one(batches):
        w = weights.astype(np.float32).copy()
        slots = len(w) - 1
        power = np.full(w.shape, POWER, np.float32)
        total = 0
        for b in batches:
            for _, _, buf, offs in tk.byte_slices(b.column("text")):
                h, shape, begin = _tokens(buf, offs)
                target, f = _classes(h, shape, frequent), _features(h, begin, slots)
                total += len(h)
                for i in range(0, len(h), MINIBATCH):
                    ff, tt = f[i : i + MINIBATCH], target[i : i + MINIBATCH]
                    z = _logits(w, ff)
                    z -= z.max(axis=1, keepdims=True)
                    np.exp(z, out=z)
                    z /= z.sum(axis=1, keepdims=True)
                    z[np.arange(len(tt)), tt] -= 1
                    rows = ff.T.ravel()
                    order = np.argsort(rows, kind="stable")
                    sorted_rows = rows[order]
                    edge = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
                    g = np.add.reduceat(z[order % len(tt)], edge, axis=0)
                    at = sorted_rows[edge]
                    power[at] += g * g
                    w[at] -= RATE * g / np.sqrt(power[at])
                    g = z.sum(axis=0)
                    power[-1] += g * g
                    w[-1] -= RATE * g / np.sqrt(power[-1])
        return w, total

    def parts(batches):
        for shard, own in _shards(batches):
            w, total = one(own)
            yield shard, float(total), np.append(w.ravel(), np.float32(1))

    return parts


def _score(weights, frequent, keys, logs, norm):
    """Texts -> per text what needs no further count, and its tokens outside the table of known counts."""
    w, single = weights.astype(np.float32), np.arange(CLASSES)
    single = (single < FREQUENT) | (single == END_CLASS)

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = b.column("id")
            for i, j, buf, offs in tk.byte_slices(b.column("text"), tk.SLICE // 2):
                h, shape, begin = _tokens(buf, offs)
                cls, f = _classes(h, shape, frequent), _features(h, begin, len(w) - 1)
                model = np.empty(len(h))
                for c in range(0, len(h), MINIBATCH):
                    z = _logits(w, f[c : c + MINIBATCH])
                    top = z.max(axis=1)
                    own = z[np.arange(len(z)), cls[c : c + MINIBATCH]]
                    model[c : c + MINIBATCH] = own - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
                model = model / np.log(10) - norm[cls]
                at = _lookup(keys, h)
                known = at >= 0
                base = np.where(known, logs[at] if len(logs) else 0.0, 0.0)
                model += np.where(single[cls], 0.0, base)
                doc = np.repeat(np.arange(j - i), np.diff(begin))
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((h[rare], doc[rare]))]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                head = np.flatnonzero(new)
                times = np.diff(np.concatenate([head, [len(order)]]))
                offsets = pa.array(np.searchsorted(doc[order[head]], np.arange(j - i + 1)), pa.int32())
                sums = [np.bincount(doc, v, minlength=j - i) for v in (known, base, model)]
                yield pa.record_batch(
                    [pa.array((np.int64(part) << 40) + row + np.arange(j - i)), ids.slice(i, j - i), pa.array(np.diff(begin)),
                     pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                     pa.ListArray.from_arrays(offsets, pa.array(h[order[head]].view(np.int64))),
                     pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                    names=["row", "id", "n_tokens", "known", "base", "model", "rare", "times"])
                row += j - i

    return run


class LanguageModel:
    """Counts and weights; fit() learns them and score() applies them."""

    def __init__(self, counts: DataFrame, train_tokens: int, types: int, weights, frequent, keys, known_counts, norm):
        self.counts, self.train_tokens, self.types = counts, train_tokens, types
        self.weights, self.frequent, self.keys, self.known_counts, self.norm = weights, frequent, keys, known_counts, norm


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """Learn from all rows of docs. Null texts are empty: an end token alone. No rows: uniform over classes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = rows.select("text").mapInArrow(_count, "h long, shape int, n long").groupBy("h").agg(
        F.first("shape").alias("shape"), F.sum("n").alias("c"))
    counts = written(counts, "lm-counts")
    ends = int(END.astype(np.int64))
    # the commonest tokens whose counts are whole: the least count that KNOWN tokens at most reach, from a histogram
    reached = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(W.orderBy(F.desc("c"))))  # one row per different count
    least = reached.where(F.col("all") <= KNOWN).agg(F.min("c")).first()[0]
    top = counts.where(F.col("c") >= least).select("h", "c").collect() if least is not None else []
    top.sort(key=lambda r: (-r.c, r.h))
    frequent = np.sort(np.array([r.h for r in top if r.h != ends][:FREQUENT], np.int64).view(np.uint64))
    keys = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, known_counts = keys[order], np.array([r.c for r in top], np.int64)[order]
    # tokens and types of each shape class, without the tokens that are classes of their own
    own = [int(x) for x in frequent.view(np.int64)] + [ends]
    per = counts.groupBy("shape").agg(
        F.sum("c").alias("all"), F.count("*").alias("types"),
        F.sum(F.when(~F.col("h").isin(own), F.col("c")).otherwise(0)).alias("n"), F.count(F.when(~F.col("h").isin(own), 1)).alias("v")).collect()
    tokens, types = sum(r["all"] for r in per), sum(r.types for r in per)
    norm = np.zeros(CLASSES)
    norm[FREQUENT:END_CLASS] = np.log10(0.5)
    for r in per:
        norm[FREQUENT + r["shape"]] = np.log10(r.n + 0.5 * (r.v + 1))
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << max(0, tokens // TOKENS_PER_SLOT).bit_length()))
    weights = np.zeros((slots + 1, CLASSES), np.float32)
    shards = max(1, -(-tokens // (SHARD_TOKENS * ROUNDS)))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    for k in range(ROUNDS):
        share = rows.where(F.pmod(F.xxhash64(name, F.lit(31)), F.lit(ROUNDS)) == k)
        share = share.withColumn("shard", F.pmod(F.hash(F.xxhash64(name, F.lit(37))), F.lit(shards)))
        share = share.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "id", "text").select("shard", "text")
        total = scaled_sum(share, _train(weights, frequent), weights.size + 1)
        if total[-1]:
            weights = (total[:-1] / total[-1]).reshape(weights.shape).astype(np.float32)
    return LanguageModel(counts, tokens, types, weights, frequent, keys, known_counts, norm)


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score, both log10 probabilities of the text.

    A null or empty text is its end token. Repeated rows are scored one by one; no rows give no rows; other
    columns are ignored; long texts are taken whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    logs = np.log10(model.known_counts + 0.5)
    parts = rows.mapInArrow(
        _score(model.weights, model.frequent, model.keys, logs, model.norm),
        "row long, id long, n_tokens long, known long, base double, model double, rare array<long>, times array<int>")
    parts = written(parts, "lm-parts")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("h"), F.col("t.times").alias("n"))
    part = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)  # the end token is a class of its own, whose model score is whole
    found = rare.join(model.counts.select("h", "c"), "h", "left").groupBy("row").agg(
        F.sum(part).alias("rest"), F.sum(F.when(F.col("h") != int(END.astype(np.int64)), part)).alias("own"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"))
    base_norm = float(np.log10(model.train_tokens + 0.5 * (model.types + 1)))
    rest = F.coalesce("rest", F.lit(0.0))
    return parts.drop("rare", "times").join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * base_norm).alias("base_score"), (F.col("model") + F.coalesce("own", F.lit(0.0))).alias("score"))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out and score all rows."""
    model = fit(docs.where(~held_out(F.col(id_col))), id_col, text_col)
    return score(docs, model, id_col, text_col).withColumn("held_out", held_out(F.col(id_col)))
