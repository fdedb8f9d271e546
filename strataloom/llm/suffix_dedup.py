"""Removal of repeated 50-byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes when a LENGTH-byte string over it also starts in a document with a smaller id. Equal strings have
the same anchor, the place of the smallest hash of their GRAM-byte grams, so strings are compared anchor by
anchor: consecutive strings of a document with one anchor are one suffix key, the bytes from the anchor on,
then those before it, backwards.

1. Distinguishing prefixes: the gram hashes of all anchors, 40 bits or more each, go to buckets as arrays; only
   those that two documents share come back. Other suffixes cannot repeat and are never sorted.
2. Runs: the texts are written once, in runs of RUN_BYTES and in buckets by run, and do not move again: all
   that later steps find out is joined to them by the run. Each run sorts the keys of its documents that are
   left, merges equal keys, front-codes them and sends every reducer its part. Text copied within a run is
   sent once, so a passage that very many documents share is one key per run.
3. Reducers merge their runs with a loser tree that keeps the common prefix of each candidate with the last
   key put out and never compares known prefixes again. Two keys share a string of LENGTH bytes if they agree
   on enough bytes on both sides of the anchor; the smallest document of every string goes back to the runs.
4. Runs turn the answers into removed bytes. Whole copies of a document with a smaller id are removed by an
   aggregate over digests beforehand and take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import textkit as tk
from strataloom.llm.common import bucketed, drop_written, written

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1  # strings per anchor at most
#: Layout of a suffix key: the right part and its length, the left part backwards and its length, the number
#: of strings; padded to whole words.
LEFT, N_LEFT, N_STRINGS, KEY = LENGTH + 1, LENGTH + SPAN, LENGTH + SPAN + 1, 8 * -(-(LENGTH + SPAN + 2) // 8)
RUN_BYTES = 1 << 22
KEYS_PER_REDUCER = 60_000
ANCHORS_PER_BUCKET = 4_000_000
#: Spark writes no table in more buckets.
MOST_FILES = 100_000


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first string, number of strings, anchor, hash) of every suffix key of some texts."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if len(buf) < LENGTH:
        return none
    up, down = tk.powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    gram = tk.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(buf) - GRAM + 1])
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    have = 1
    while have < SPAN:
        step = min(have, SPAN - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    start = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(offs[:-1], offs[1:]) if b - a >= LENGTH] or [np.zeros(0, np.int64)])
    if not len(start):
        return none
    at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(offs, start, side="right") - 1
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    return doc[head], start[head], np.diff(np.append(head, len(start))), at[head], gram[at[head]]


def _texts():
    """Texts -> runs of RUN_BYTES of them or a little more."""

    def one(run: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([run]), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], names=["run", "ids", "texts"])

    def run(batches):
        part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            for k, text in zip(b.column("id").to_pylist(), b.column("text")):
                ids.append(k)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= RUN_BYTES:
                    yield one((part << 32) + n, ids, texts)
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield one((part << 32) + n, ids, texts)

    return run


def _rows(batches):
    """Every row of some batches, as Arrow scalars by name."""
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(i)[k] for i, name in enumerate(b.schema.names)}


def _taking_part(row: dict) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(places, ids, texts) of the documents of a run that have an id and are no whole copies."""
    own = np.array([k is not None for k in row["ids"].as_py()], dtype=bool)
    if "copies" in row:
        own[row["copies"].as_py() or []] = False
    places = np.flatnonzero(own)
    return places, row["ids"].values.take(pa.array(places)).to_numpy(), row["texts"].values.take(pa.array(places))


def _bucket_rows(n_buckets: int):
    """Runs of texts -> (bucket, run, ids, owner, hashes): all anchors of a slice, dealt by hash."""

    def run(batches):
        for row in _rows(batches):
            _, ids, texts = _taking_part(row)
            for i, j, buf, offs in tk.byte_slices(texts):
                doc, _, _, _, h = anchors(buf, offs)
                bucket = (h % np.uint64(n_buckets)).astype(np.int64)
                rest = (h // np.uint64(n_buckets) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                full = np.flatnonzero(np.diff(edge))
                cols: list[list] = [[], [], []]
                for q in full:
                    own = order[edge[q] : edge[q + 1]]
                    docs, owner = np.unique(doc[own], return_inverse=True)
                    for c, v in zip(cols, (ids[i:j][docs], owner.astype(np.uint32), rest[own])):
                        c.append(v.tobytes())
                yield pa.record_batch(
                    [pa.array(full, pa.int32()), pa.array([row["run"].as_py()] * len(full), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)],
                    names=["bucket", "run", "ids", "owner", "hashes"])

    return run


def _shared(t: pa.Table) -> pa.Table:
    """One bucket -> per run the hashes that two documents of any runs have, each once, and of how many anchors they are."""
    ids = [np.frombuffer(x, np.int64) for x in t["ids"].to_pylist()]
    owner = np.concatenate([d[np.frombuffer(o, np.uint32)] for d, o in zip(ids, t["owner"].to_pylist())])
    parts = t["hashes"].to_pylist()
    runs, of = np.unique(t["run"].to_numpy(), return_inverse=True)
    run = np.repeat(of, [len(x) // 4 for x in parts])
    h = np.frombuffer(b"".join(parts), np.uint32)
    order = np.lexsort((owner, h))
    h, owner, run = h[order], owner[order], run[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    last = (np.append(edge[1:], len(h)) - 1)[: len(edge)]
    twice = np.repeat(owner[edge] != owner[last], np.diff(np.append(edge, len(h))))
    both, n = np.unique(run[twice].astype(np.uint64) << np.uint64(32) | h[twice], return_counts=True)
    run, h = (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)
    found, first = np.unique(run, return_index=True)
    edge = np.append(first, len(h))
    return pa.table({
        "run": pa.array(runs[found], pa.int64()), "bucket": pa.array([t["bucket"][0].as_py()] * len(found), pa.int32()),
        "anchors": pa.array([int(n[a:b].sum()) for a, b in zip(edge[:-1], edge[1:])], pa.int64()),
        "hashes": pa.array([h[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())})


def _keys(buf, start, strings, at) -> np.ndarray:
    """Suffix keys as rows of KEY bytes."""
    key = np.zeros((len(at), KEY), np.uint8)
    n_left = at - start
    n_right = LENGTH + strings - 1 - n_left
    padded = np.concatenate([np.zeros(SPAN, np.uint8), buf, np.zeros(LENGTH, np.uint8)])
    for c in range(LENGTH):
        key[:, c] = np.where(c < n_right, padded[at + SPAN + c], 0)
    key[:, LENGTH] = n_right
    for c in range(SPAN - 1):
        key[:, LEFT + c] = np.where(c < n_left, padded[at + SPAN - 1 - c], 0)
    key[:, N_LEFT], key[:, N_STRINGS] = n_left, strings
    return key


def _sorted(key: np.ndarray) -> np.ndarray:
    words = key.view(">u8").astype(np.uint64).reshape(len(key), -1)
    return np.lexsort(words.T[::-1])


def _common(key: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row with the row before; 0 for the first."""
    out = np.zeros(len(key), np.int64)
    for i in range(1, len(key), 1 << 16):
        a = key[i - 1 : i - 1 + (1 << 16)][: len(key) - i]
        b = key[i : i + (1 << 16)]
        odd = a != b
        out[i : i + len(b)] = np.where(odd.any(axis=1), odd.argmax(axis=1), key.shape[1])
    return out


def front_coded(key: np.ndarray) -> bytes:
    """Sorted keys: their number, the common prefix lengths, and the bytes that are left of each."""
    lcp = _common(key).astype(np.uint8)
    rest = key[np.arange(key.shape[1])[None, :] >= lcp[:, None]]
    return len(key).to_bytes(4, "little") + lcp.tobytes() + rest.tobytes()


def front_decoded(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    lcp = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
    rest = np.frombuffer(raw, np.uint8, offset=4 + n)
    key = np.zeros((n, KEY), np.uint8)
    own = np.arange(KEY)[None, :] >= lcp[:, None]
    key[own] = rest
    # a byte that was left out is that of the last row above which has its own there
    above = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), axis=0)
    return key[above, np.arange(KEY)[None, :]], lcp


def packed(*parts: bytes) -> bytes:
    """Some byte strings as one, compressed: their number and lengths, and what zstd makes of them."""
    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return head + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> list[bytes]:
    n = int.from_bytes(raw[:4], "little")
    edge = np.cumsum([0, *np.frombuffer(raw, "<u4", n, 4).tolist()]).tolist()
    body = pa.decompress(raw[4 + 4 * n :], edge[-1], codec="zstd", asbytes=True)
    return [body[a:b] for a, b in zip(edge[:-1], edge[1:])]


def merged(runs: list[tuple[list[bytes], list[int]]]) -> list[tuple[int, int]]:
    """(run, place) in the order of the keys, by a loser tree over sorted runs with their common prefixes.

    A candidate carries the length of its common prefix with the last key put out. Of two candidates the one
    with the longer prefix is smaller, and the other keeps its length; at equal lengths bytes are compared
    from there on, and the larger takes over the length that they turn out to have in common.
    """
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    lcp = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), by runs."""
        if a >= len(runs) or at[a] >= len(runs[a][0]):
            return b, a
        if b >= len(runs) or at[b] >= len(runs[b][0]):
            return a, b
        la, lb = lcp[a], lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        x, y = runs[a][0][at[a]], runs[b][0][at[b]]
        if x == y:
            lcp[b] = KEY
            return a, b
        while x[la] == y[la]:
            la += 1
        if x[la] < y[la]:
            lcp[b] = la
            return a, b
        lcp[a] = la
        return b, a

    tree = [0] * (2 * size)
    winners = list(range(size))
    level = size
    while level > 1:
        nxt = []
        for i in range(0, level, 2):
            w, tree[(level + i) // 2] = play(winners[i], winners[i + 1])
            nxt.append(w)
        winners, level = nxt, level // 2
    w, out = winners[0], []
    total = sum(len(r[0]) for r in runs)
    while len(out) < total:
        k = at[w]
        out.append((w, k))
        at[w] = k + 1
        lcp[w] = runs[w][1][k + 1] if k + 1 < len(runs[w][0]) else 0
        node = (size + w) // 2
        while node:
            w, tree[node] = play(w, tree[node])
            node //= 2
    return out


def _answer(t: pa.Table) -> pa.Table:
    """One reducer: its parts of all runs -> per run (key, first and last distance to the anchor, smallest document)."""
    run_ids = t["run"].to_pylist()
    bodies = [unpacked(x) for x in t["body"].to_pylist()]
    decoded = [front_decoded(x) for x, _, _ in bodies]
    least = [np.frombuffer(x, np.int64) for _, x, _ in bodies]
    many = [np.frombuffer(x, np.bool_) for _, _, x in bodies]
    number = [np.arange(n, n + len(x), dtype=np.int32) for n, x in zip(t["number"].to_pylist(), least)]
    order = np.array(merged([([r.tobytes() for r in key], lcp.tolist()) for key, lcp in decoded]))
    base = np.cumsum([0, *(len(k) for k, _ in decoded)])
    row = base[order[:, 0]] + order[:, 1]
    key = np.concatenate([k for k, _ in decoded])[row]
    least, many, number = (np.concatenate(x)[row] for x in (least, many, number))
    run = order[:, 0]
    n_left, strings = key[:, N_LEFT].astype(np.int64), key[:, N_STRINGS].astype(np.int64)
    right = np.minimum(_common(key[:, : LENGTH]), LENGTH)
    left_key = np.zeros((len(key), 8 * -(-SPAN // 8)), np.uint8)
    left_key[:, : SPAN - 1] = key[:, LEFT : LEFT + SPAN - 1]
    by_left = _sorted(left_key)
    left = _common(left_key[by_left])
    parts = []
    for r in range(SPAN):  # strings that start r bytes before the anchor
        own = np.flatnonzero((n_left - strings < r) & (r <= n_left))
        if not len(own):
            continue
        right_class = np.cumsum(right < LENGTH - r)
        left_class = np.empty(len(key), np.int64)
        left_class[by_left] = np.cumsum(left < r)
        _, cls = np.unique(right_class[own] * np.int64(len(key) + 1) + left_class[own], return_inverse=True)
        low = np.full(cls.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, cls, least[own])
        low = low[cls]
        tell = (low < least[own]) | many[own]
        parts.append((own[tell], np.full(int(tell.sum()), r), low[tell]))
    own, r, low = (np.concatenate(c) if parts else np.zeros(0, np.int64) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((r, own))
    own, r, low = own[order], r[order], low[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (r[1:] != r[:-1] + 1) | (low[1:] != low[:-1])
    head = np.flatnonzero(new)
    tail = (np.append(head[1:], len(own)) - 1)[: len(head)]
    own, first, last, low = own[head], r[head], r[tail], low[head]
    order = np.argsort(run[own], kind="stable")
    own, first, last, low = own[order], first[order], last[order], low[order]
    edge = np.searchsorted(run[own], np.arange(len(run_ids) + 1))
    out = [(run_ids[k], *(x[edge[k] : edge[k + 1]].tobytes() for x in (number[own], first.astype(np.uint8), last.astype(np.uint8), low)))
           for k in range(len(run_ids)) if edge[k] < edge[k + 1]]
    names = ("run", "number", "first", "last", "low")
    kinds = (pa.int64(), *[pa.binary()] * 4)
    return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds))})


RUNS = "run long, member_new binary, member_at binary, parts array<struct<reducer:int,number:int,body:binary>>"
ARROW_PART = pa.list_(pa.struct([("reducer", pa.int32()), ("number", pa.int32()), ("body", pa.binary())]))


def _runs(n_buckets: int, n_reducers: int):
    """(run, ids, texts, bucket hashes, copies) -> sorted runs: where each key begins, where its anchors are, and the part of every reducer."""

    def one(row: dict) -> pa.RecordBatch:
        _, ids, texts = _taking_part(row)
        sizes = np.array([len(x) for x in texts.to_pylist()], np.int64)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        buf = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
        found = [tuple(c + x for c, x in zip(anchors(b, o), (i, offs[i], 0, offs[i], np.uint64(0)))) for i, _, b, o in tk.byte_slices(texts)]
        doc, start, strings, at, h = (np.concatenate(c) for c in zip(*found)) if found else anchors(buf, offs)
        bucket, rest = (h % np.uint64(n_buckets)).astype(np.uint64), h // np.uint64(n_buckets) & np.uint64(0xFFFFFFFF)
        want = [np.uint64(s["bucket"]) << np.uint64(32) | np.frombuffer(s["hashes"], np.uint32) for s in row["shared"].as_py()]
        keep = np.flatnonzero(np.isin(bucket << np.uint64(32) | rest, np.concatenate(want)))
        doc, at, h = doc[keep], at[keep], h[keep]
        key = _keys(buf, start[keep], strings[keep], at)
        reducer = (tk.mix(h) % np.uint64(n_reducers)).astype(np.int64)
        order = _sorted(key)
        order = order[np.argsort(reducer[order], kind="stable")]
        key, doc, at, reducer = key[order], doc[order], at[order], reducer[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        head = np.flatnonzero(new)
        least = np.minimum.reduceat(ids[doc], head) if len(head) else np.zeros(0, np.int64)
        many = (np.maximum.reduceat(ids[doc], head) if len(head) else least) != least
        edge = np.searchsorted(reducer[head], np.arange(n_reducers + 1))
        parts = []
        for q in np.flatnonzero(np.diff(edge)).tolist():
            a, b = int(edge[q]), int(edge[q + 1])
            parts.append({"reducer": q, "number": a, "body": packed(front_coded(key[head[a:b]]), least[a:b].tobytes(), many[a:b].tobytes())})
        return pa.record_batch(
            [pa.array([row["run"].as_py()]), pa.array([new.tobytes()], pa.binary()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([parts], ARROW_PART)],
            names=["run", "member_new", "member_at", "parts"])

    def run(batches):
        for row in _rows(batches):
            yield one(row)

    return run


def _gone(row: dict, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which bytes the answers of a run remove."""
    step = np.zeros(offs[-1] + 1, np.int32)
    answers = row["answers"].as_py() or []
    if answers:
        number = np.cumsum(np.frombuffer(row["member_new"].as_py(), np.bool_)) - 1
        at = np.frombuffer(row["member_at"].as_py(), np.uint32).astype(np.int64)
        doc = np.searchsorted(offs, at, side="right") - 1
    for a in answers:
        key, first, last, low = (np.frombuffer(a[c], t) for c, t in (("number", np.int32), ("first", np.uint8), ("last", np.uint8), ("low", np.int64)))
        lo, hi = np.searchsorted(number, key), np.searchsorted(number, key, side="right")
        each = np.repeat(np.arange(len(key)), hi - lo)
        member = np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each]
        later = ids[doc[member]] > low[each]
        member, each = member[later], each[later]
        np.add.at(step, at[member] - last[each], 1)
        np.add.at(step, at[member] - first[each] + LENGTH, -1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def _removed(batches):
    """Runs with their answers -> (id, n_bytes, n_removed, n_spans, kept)."""
    for row in _rows(batches):
        places, ids, texts = _taking_part(row)
        own = texts.to_pylist()
        offs = np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)])
        buf = np.frombuffer(b"".join(own), np.uint8)
        gone = _gone(row, ids, offs)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offs[:-1][np.diff(offs) > 0]
        begins[inner] = gone[inner]
        kept = row["texts"].as_py()
        n_bytes = np.array([len(x) for x in kept], np.int64)
        count = np.zeros((2, len(kept)), np.int64)
        for k in row["copies"].as_py() or []:
            count[:, k], kept[k] = (n_bytes[k], 1), b""
        for c, x in zip(count, (gone, begins)):
            c[places] = np.diff(np.concatenate([[0], np.cumsum(x)])[offs])
        for k, x, y in zip(places.tolist(), offs[:-1].tolist(), offs[1:].tolist()):
            if count[0, k]:
                kept[k] = buf[x:y][~gone[x:y]].tobytes()
        yield pa.record_batch(
            [pa.array(row["ids"].as_py(), pa.int64()), *(pa.array(c) for c in (n_bytes, *count)), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text the bytes kept, too.

    Null texts are empty; texts of under LENGTH bytes lose nothing. Only strictly smaller ids count, so rows
    that repeat an id leave each other alone; rows without an id lose nothing and take nothing. Bytes are
    judged on the input; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    sized = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_buckets = max(16, int(2 * sized / (SPAN + 1) / ANCHORS_PER_BUCKET) + 1)
    # with fewer buckets than an exchange has partitions Spark would deal out the texts, too
    n_files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(sized // (2 * RUN_BYTES) + 1, MOST_FILES))
    texts = bucketed(rows.mapInArrow(_texts(), "run long, ids array<long>, texts array<binary>"), "repeats-texts", "run", n_files)
    each = texts.select("run", F.posexplode(F.arrays_zip("ids", "texts")).alias("place", "d")).select("run", "place", F.col("d.ids").alias("id"), F.col("d.texts").alias("text"))
    long = each.where(f"octet_length(text) >= {LENGTH} and id is not null").select("run", "place", "id", F.unhex(F.sha2("text", 256)).alias("sha"))
    digests = written(long, "repeats-digests")
    firsts = digests.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = digests.join(firsts, "sha").where("id > first").groupBy("run").agg(F.collect_list("place").alias("copies"))
    copies = written(copies, "repeats-copies")
    drop_written(digests)
    shared = texts.mapInArrow(_bucket_rows(n_buckets), "bucket int, run long, ids binary, owner binary, hashes binary")
    shared = written(shared.groupBy("bucket").applyInArrow(_shared, "run long, bucket int, anchors long, hashes binary"), "repeats-shared")
    n_reducers = max(12, (shared.agg(F.sum("anchors").alias("n")).first()["n"] or 0) // KEYS_PER_REDUCER + 1)
    # whole copies go; runs that share no anchor stay as they are
    held = texts.join(shared.repartition(n_files, "run").groupBy("run").agg(F.collect_list(F.struct("bucket", "hashes")).alias("shared")), "run").join(copies, "run", "left")
    runs = bucketed(held.mapInArrow(_runs(n_buckets, n_reducers), RUNS), "repeats-runs", "run", n_files)
    drop_written(shared)
    parts = runs.select("run", F.explode("parts").alias("p")).select("run", "p.*")
    answers = parts.groupBy("reducer").applyInArrow(_answer, "run long, number binary, first binary, last binary, low binary")
    answers = written(answers, "repeats-answers")
    answers = answers.repartition(n_files, "run").groupBy("run").agg(F.collect_list(F.struct("number", "first", "last", "low")).alias("answers"))
    cut = texts.join(runs.drop("parts"), "run", "left").join(answers, "run", "left").join(copies, "run", "left")
    cut = cut.mapInArrow(_removed, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    cut = cut.select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *(["kept"] if keep_text else []))
    return cut.withColumnRenamed("id", id_col)
