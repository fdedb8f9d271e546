"""Removal of training documents that hold benchmark passages, by suffix arrays of the training text.

1. Documents are cut into shards of whole texts. A shard's words are told apart exactly by an Arrow dictionary and its
   suffixes are sorted by prefix doubling: the first ranks come from several words at once, and each further step sorts
   only the groups that are still tied, until no group is left or the longest test item is reached.
2. Every suffix of every test item is searched in the shard's array by bisection, word after word: both ends of the
   range of suffixes that begin with what has been read so far. The word at which the range becomes empty gives the
   longest verbatim match; the range at WINDOW words holds all occurrences of that window.
3. Occurrences mark words of their documents and name the items. All of it stays with the documents' rows: nothing is
   shuffled by content, so a passage in every document costs no more than its marks.

The test items are a stated query set: they go to all shards in blocks of a bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm import textkit as tk
from strataloom.llm.common import written

WINDOW = 10
#: What separates words: all of ASCII but digits and letters.
APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: Bytes of text of a shard, unless one document has more.
SHARD_BYTES = 4 << 20
#: Bytes of test text that are sent at a time.
BLOCK_BYTES = 32 << 20


def words(col: pa.Array | pa.ChunkedArray, limit: int = SHARD_BYTES):
    """Runs of whole texts -> (first row, end row, index of each word, the words that indexes stand for, first word of each text)."""
    for i, j, buf, offs in tk.byte_slices(col, limit):
        buf = tk.LOWER[buf]
        starts, ends, first = tk.word_bounds(buf, offs, APART)
        edge = np.concatenate([[0], np.cumsum(ends - starts)])
        solid = buf[~APART[buf]]
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(solid)]).dictionary_encode()
        yield i, j, found.indices.to_numpy().astype(np.int64), found.dictionary, first


class Tests:
    """The items of a block: their words as numbers, and for each word the suffix that begins there."""

    def __init__(self, names: list[str | None], texts: list[str | None], window: int = WINDOW):
        self.window = window
        self.names = sorted({n for n in names if n is not None})
        place = {n: k for k, n in enumerate(self.names)}
        name = np.array([place.get(n, -1) for n in names], np.int64)
        col = pa.array(texts, pa.large_string())
        parts = list(words(col, max(1, col.nbytes)))
        _, _, self.words, self.vocabulary, first = parts[0] if parts else (0, 0, np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(1, np.int64))
        count = np.diff(first)
        self.item = np.repeat(np.arange(len(count)), count)
        self.name = name[self.item] if len(name) else self.item
        self.start = np.arange(len(self.words)) - np.repeat(first[:-1], count)  # place within its item
        self.left = np.repeat(first[1:], count) - np.arange(len(self.words))  # words from here to the end of the item
        self.need = np.minimum(window, count)[self.item] if len(count) else self.item  # words of its window
        self.deepest = int(count.max()) if len(count) else 0


def suffix_array(w: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """Places of words in the order of what follows them up to the end of their text, compared over depth words at least.

    w: numbers of the words, 0 or more; last: of each word the end of its text.
    """
    n = len(w)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(w.max() + 1).bit_length()
    have = max(1, min(62 // bits, depth, n))
    key, place = np.zeros(n, np.int64), np.arange(n)
    for k in range(have):
        key <<= bits
        key[: n - k] |= np.where(place[: n - k] + k < last[: n - k], w[k:] + 1, 0)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))  # the first row of its group
    while have < depth:
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        own = order[tied]
        nxt = own + have
        inside = nxt < last[own]
        key = rank[own] * (n + 1) + np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, own = key[by], own[by]
        order[tied] = own
        new[tied[1:]] = key[1:] != key[:-1]
        new[tied[0]] = True
        rank[own] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        have *= 2
    return order


def search(w: np.ndarray, last: np.ndarray, order: np.ndarray, tests: Tests, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every test suffix: the length of its longest match, one place of it, and its rows at the length of its window.

    code: of each word of the tests the number that it has in the shard, negative if the shard lacks it.
    """
    size = len(code)
    length, place, low, high = (np.zeros(size, np.int64) for _ in range(4))
    alive, d = np.flatnonzero(tests.left >= tests.need), 0
    a, b = np.zeros(len(alive), np.int64), np.full(len(alive), len(order))

    def bound(a, b, word, right):
        a, b = a.copy(), b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) // 2
            at = order[mid] + d
            here = np.where(at < last[order[mid]], w[np.minimum(at, len(w) - 1)], -1)
            below = here <= word[open_] if right else here < word[open_]
            a[open_] = np.where(below, mid + 1, a[open_])
            b[open_] = np.where(below, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        return a

    while len(alive):
        word = code[alive + d]
        known = word >= 0
        alive, a, b, word = alive[known], a[known], b[known], word[known]
        a, b = bound(a, b, word, False), bound(a, b, word, True)
        some = a < b
        alive, a, b = alive[some], a[some], b[some]
        d += 1
        length[alive], place[alive] = d, order[a]
        full = tests.need[alive] == d
        low[alive[full]], high[alive[full]] = a[full], b[full]
        more = tests.left[alive] > d
        alive, a, b = alive[more], a[more], b[more]
    return length, place, low, high


def _searched(col, tests: Tests):
    """Shards of a column of texts with the answers to all test suffixes."""
    for i, j, w, own, first in words(col):
        last = np.repeat(first[1:], np.diff(first))
        order = suffix_array(w, last, tests.deepest)
        known = pc.index_in(tests.vocabulary, value_set=own).fill_null(-1).to_numpy().astype(np.int64)
        code = known[tests.words] if len(known) else tests.words
        yield i, j, first, order, search(w, last, order, tests, code)


SPANS = "array<struct<start:long,words:long>>"
HITS = f"n_words long, spans {SPANS}, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))


def _lists(values: pa.Array, per_row: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), values)


def _spans(step: np.ndarray, first: np.ndarray) -> pa.Array:
    """Differences of the number of marks from word to word -> per text its maximal runs of marked words."""
    hit = np.cumsum(step[:-1]) > 0
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1]
    end[:-1] &= ~hit[1:]
    inner = first[(first > 0) & (first < len(hit))]
    begin[inner] = hit[inner]
    end[inner - 1] = hit[inner - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    text = np.searchsorted(first, begin, side="right") - 1
    runs = pa.StructArray.from_arrays([pa.array(begin - first[text]), pa.array(end - begin)], fields=list(_SPANS.value_type))
    return _lists(runs, np.bincount(text, minlength=len(first) - 1))


def _hits(sent):
    """(..., text) -> (..., n_words, spans, items) against the tests of one block."""

    def run(batches):
        tests: Tests = sent.value
        for b in batches:
            keys = b.select([c for c in b.schema.names if c != "text"])
            for i, j, first, order, (length, _, low, high) in _searched(b.column("text"), tests):
                full = np.flatnonzero((length >= tests.need) & (tests.left >= tests.need))
                # equal windows have the same rows; each is looked at once, for all its items
                kind, at, of = np.unique(low[full] * (tests.window + 1) + tests.need[full], return_index=True, return_inverse=True)
                count = (high - low)[full[at]]
                which = np.repeat(np.arange(len(kind)), count)
                place = order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[full[at]][which]]
                n = int(first[-1])
                step = np.bincount(place, minlength=n + 1) - np.bincount(place + tests.need[full[at]][which], minlength=n + 1)
                names = [np.unique(x[x >= 0]) for x in np.split(tests.name[full[np.argsort(of, kind="stable")]], np.cumsum(np.bincount(of, minlength=len(kind)))[:-1])]
                text = np.searchsorted(first, place, side="right") - 1
                pair = np.unique(text * max(1, len(kind)) + which)
                text, which = pair // max(1, len(kind)), pair % max(1, len(kind))
                hit, edge = np.unique(text, return_index=True)
                per, items, memo = np.zeros(j - i, np.int64), [], {}
                for t, kinds in zip(hit, np.split(which, edge[1:])):
                    found = memo.get(kinds.tobytes())
                    if found is None:
                        found = memo[kinds.tobytes()] = [tests.names[k] for k in np.unique(np.concatenate([names[k] for k in kinds]))]
                    per[t] = len(found)
                    items += found
                own = keys.slice(i, j - i)
                yield pa.record_batch(
                    [*own.columns, pa.array(np.diff(first)), _spans(step, first), _lists(pa.array(items, pa.string()), per)],
                    names=[*keys.schema.names, "n_words", "spans", "items"])

    return run


def _merged(batches):
    """Spans of several blocks, in any order -> maximal runs."""
    for b in batches:
        out = []
        for row in b.column("spans").to_pylist():
            runs: list[list[int]] = []
            for s, n in sorted((x["start"], x["words"]) for x in row):
                if runs and s <= runs[-1][0] + runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s + n - runs[-1][0])
                else:
                    runs.append([s, n])
            out.append([{"start": s, "words": n} for s, n in runs])
        at = b.schema.names.index("spans")
        yield b.set_column(at, "spans", pa.array(out, _SPANS))


def blocks(bench: DataFrame, id_col: str, text_col: str, window: int = WINDOW):
    """The items in blocks of about BLOCK_BYTES of text, each broadcast in turn; one without words at least."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    total = bench.agg(F.sum(size).alias("n")).first()["n"] or 0
    n = 1 + total // BLOCK_BYTES
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n))
    for k in range(n):
        rows = bench.where(block == k).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toArrow()
        yield bench.sparkSession.sparkContext.broadcast(Tests(rows["i"].to_pylist(), rows["t"].to_pylist(), window))


def _contamination(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int) -> DataFrame:
    """(id, sha, n_words, spans, items) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = [rows.mapInArrow(_hits(sent), f"id {kind}, sha string, {HITS}") for sent in blocks(bench, item_col, item_text_col, window)]
    if len(found) == 1:
        return found[0]
    # rows of one id and text have the same answers; each block has every row once
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    every = every.groupBy("id", "sha").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / len(found)).cast("int").alias("_times"))
    every = every.select("*", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times", "col")
    return every.mapInArrow(_merged, f"id {kind}, sha string, {HITS}")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans are the maximal runs of hit words, by place. Null and empty texts have no words. Items without words match
    nothing; rows with the same item id are one item; a row without an item id marks words but is not named. Repeated
    rows each get a row. An empty table of documents gives no rows, one of items gives no hits. Other columns are ignored.
    """
    found = _contamination(docs, bench, id_col, text_col, item_col, item_text_col, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return found.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def decontaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of documents without a hit word, with all their columns. Null texts and ids stay as they are."""
    found = _contamination(docs, bench, id_col, text_col, item_col, item_text_col, window)
    gone = written(found.where(F.size("spans") > 0).select(F.col("id").alias("_id_"), F.col("sha").alias("_sha_")).distinct(), "contaminated")
    sha: Column = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id_"]) & (sha == gone["_sha_"]), "left_anti")


def longest_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Of every item with a window in the documents its longest verbatim match and where it is: item, item_start, n_words, doc, doc_start.

    Places count words from 0. Of matches of one length that of the smallest item_start, document and doc_start among
    the shards' own is taken; within a shard any place of the longest match may stand.
    """

    def best(sent):
        def run(batches):
            tests: Tests = sent.value
            for b in batches:
                for i, _, first, _, (length, place, _, _) in _searched(b.column("text"), tests):
                    own = np.flatnonzero((length >= tests.need) & (length > 0) & (tests.left >= tests.need) & (tests.name >= 0))
                    own = own[np.lexsort((tests.start[own], -length[own], tests.name[own]))]
                    own = own[np.unique(tests.name[own], return_index=True)[1]]
                    text = np.searchsorted(first, place[own], side="right") - 1
                    yield pa.record_batch(
                        [pa.array([tests.names[k] for k in tests.name[own]], pa.string()), pa.array(tests.start[own]), pa.array(length[own]),
                         b.column("id").take(pa.array(text + i)), pa.array(place[own] - first[text])],
                        names=["item", "item_start", "n_words", "doc", "doc_start"])

        return run

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = None
    for sent in blocks(bench, item_col, item_text_col, window):
        x = rows.mapInArrow(best(sent), f"item string, item_start long, n_words long, doc {kind}, doc_start long")
        out = x if out is None else out.unionByName(x)
    best_of = F.min(F.struct((-F.col("n_words")).alias("short"), "item_start", "doc", "doc_start"))
    return out.groupBy("item").agg(best_of.alias("b")).select("item", "b.item_start", (-F.col("b.short")).alias("n_words"), "b.doc", "b.doc_start")
