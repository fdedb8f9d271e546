"""Token-ID output: a byte-level BPE over whole texts and a store of interleaved range-coded blocks.

The store is a folder of Parquet files in ascending document order. A row is a segment: a frequency table,
shared by the segment's blocks, and the blocks. A block holds whole documents and is coded on its own by a
static range asymmetric numeral system of many interleaved lanes: id i of the block goes to lane i mod L.
Its payload has a header, the states of all lanes at checkpoints, each with its place in the word stream, and
the words; a reader can start at any checkpoint, so parts of one block can be read in parallel. Checksums
cover the payload and the ids.

    payload   magic 'RAN1', uint32 lanes, uint32 steps between checkpoints, uint64 ids, uint32 crc32 of ids,
              uint32 crc32 of all that follows, uint32 checkpoints; then per checkpoint a uint64 word offset
              and a uint64 state per lane; then the uint32 words
    table     magic 'TAB1', uint32 n, then n uint32 ids and n uint32 frequencies that sum to 2**PRECISION

Writing is one range exchange of the texts by document id; each task tokenises and codes its documents in
order, holding one segment at a time.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.llm.textkit import gathered

PRECISION = 18
LOW = np.uint64(1 << 31)
LANES = 4096
CHECKPOINT = 128
#: A block is closed at the end of the document with which it has so many ids, a segment likewise.
BLOCK_IDS = 1 << 20
SEGMENT_IDS = 1 << 22
END_ID = 2
HEAD = struct.Struct("<4sIIQIII")

BLOCKS = "array<struct<doc_ids: array<long>, lengths: array<long>, n_ids: long, payload: binary>>"
SCHEMA = f"part int, segment int, before long, n_ids long, coding binary, blocks {BLOCKS}"


def normalised(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur and frequencies of 1 at least that sum to 2**PRECISION."""
    ids = np.flatnonzero(counts)
    c = counts[ids].astype(np.float64)
    f = np.maximum(1, np.floor(c / c.sum() * ((1 << PRECISION) - len(ids)))).astype(np.int64)
    rest = (1 << PRECISION) - int(f.sum())
    if rest > 0:
        f[np.argmax(c)] += rest
    while rest < 0:  # take from the largest
        k = int(np.argmax(f))
        take = min(-rest, int(f[k]) // 2)
        f[k] -= take
        rest += take
    return ids.astype(np.uint32), f.astype(np.uint32)


def pack_table(ids: np.ndarray, freq: np.ndarray) -> bytes:
    return b"TAB1" + struct.pack("<I", len(ids)) + ids.astype("<u4").tobytes() + freq.astype("<u4").tobytes()


def unpack_table(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    if raw[:4] != b"TAB1":
        raise ValueError("no frequency table")
    (n,) = struct.unpack_from("<I", raw, 4)
    return np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, "<u4", n, 8 + 4 * n)


def encode_block(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray], lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    """Payload of one block. Lanes are halved until a lane has 64 steps or more."""
    n = len(ids)
    while lanes > 1 and n < lanes * 64:
        lanes //= 2
    syms, freq = table
    at = np.zeros(int(syms[-1]) + 1 if len(syms) else 1, np.int64)
    at[syms] = np.arange(len(syms))
    f_of = freq.astype(np.uint64)
    c_of = np.concatenate([[0], np.cumsum(freq[:-1], dtype=np.uint64)]).astype(np.uint64) if len(freq) else f_of
    k = at[ids]
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    bits, half, limit = np.uint64(PRECISION), np.uint64(32), np.uint64(63 - PRECISION)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for s in range(steps - 1, -1, -1):
        kk = k[s * lanes : (s + 1) * lanes]
        f, c = f_of[kk], c_of[kk]
        v = x[: len(kk)]
        full = (v >> limit) >= f
        words = v[full].astype(np.uint32)
        v[full] >>= half
        q = v // f
        x[: len(kk)] = (q << bits) + (v - q * f) + c
        out.append(words)
        written += len(words)
        if s % every == 0:
            marks.append((written, x.copy()))
    marks.reverse()
    body = b"".join(struct.pack("<Q", written - w) + st.astype("<u8").tobytes() for w, st in marks)
    body += b"".join(w.astype("<u4").tobytes() for w in reversed(out))
    head = HEAD.pack(b"RAN1", lanes, every, n, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body), len(marks))
    return head + body


class Table:
    """What decoding needs of a frequency table: the symbol of every slot."""

    def __init__(self, raw: bytes):
        self.ids, freq = unpack_table(raw)
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq[:-1], dtype=np.uint64)]).astype(np.uint64) if len(freq) else self.freq
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def block_checkpoints(payload: bytes) -> int:
    return HEAD.unpack_from(payload)[6]


def decode_block(payload: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a block, or of its checkpoints first to last - 1; checksums are verified."""
    magic, lanes, every, n, crc_ids, crc_body, marks = HEAD.unpack_from(payload)
    body = memoryview(payload)[HEAD.size :]
    if magic != b"RAN1" or zlib.crc32(body) != crc_body:
        raise ValueError("a block is damaged")
    if not n:
        return np.zeros(0, np.uint32)
    mark = 8 + 8 * lanes
    words = np.frombuffer(body, "<u4", offset=marks * mark)
    last = marks if last is None else last
    steps = min(last * every, -(-n // lanes)) - first * every
    (p,) = struct.unpack_from("<Q", body, first * mark)
    x = np.frombuffer(body, "<u8", lanes, first * mark + 8).copy()
    mask, bits, half = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32)
    start = first * every * lanes
    end = min(n, start + steps * lanes)
    out = np.empty(end - start, np.uint32)
    for s in range(steps):
        lo = s * lanes
        v = x[: min(lanes, len(out) - lo)]
        low = v & mask
        k = table.slot[low]
        out[lo : lo + len(v)] = k
        v[:] = table.freq[k] * (v >> bits) + low - table.cum[k]
        short = np.flatnonzero(v < LOW)
        if len(short):
            v[short] = (v[short] << half) | words[p : p + len(short)].astype(np.uint64)
            p += len(short)
    ids = table.ids[out]
    if start == 0 and end == n and zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("the ids of a block differ from those that were written")
    return ids


_tokenizers: dict[str, TextIds] = {}
#: White space as the pre-tokeniser sees it, without and with the space and the line end.
OTHER_WHITE = r"\x{9}\x{B}-\x{D}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE = rf" \n{OTHER_WHITE}"
#: White space that the library must see in its surroundings.
ODD = rf" [{WHITE}]| $"
#: White space other than single spaces and line ends between words.
UNEVEN = rf"[{OTHER_WHITE}]|[ \n][ \n]|^[ \n]|[ \n]$"
MARKS = ".,;:!?"
#: Texts are taken in slices of about so many bytes.
SLICE = 8 << 20
#: The memo of words starts anew beyond so many.
MEMO = 400_000


def _byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary of a byte-level model."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    unseen = [b for b in range(256) if b not in set(seen)]
    of = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(unseen)}
    return [of[b] for b in range(256)]


class TextIds:
    """Ids of whole texts by the tokenizers library, distinct word by distinct word.

    The byte-level pre-tokeniser always starts a new piece at a space that a non-space follows, at a line end
    between two non-spaces and after it, and between a letter and a run of punctuation that ends a word. So
    texts are cut there by Arrow, equal words are found by its dictionaries, and the ids of distinct words are
    remembered in a bounded memo; words of letters alone are single pieces and go to the library's model, other
    words to the whole library. Texts with other runs of white space around a space go to the library whole, as
    do all texts of a tokenizer that is set up otherwise.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            setup = json.load(f)
        before = setup.get("pre_tokenizer") or {}
        self.newline = self.whole("\n")
        self.cuttable = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not setup.get("normalizer")
            and setup["model"].get("type") == "BPE" and not setup["model"].get("dropout") and len(self.newline) == 4)
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> TextIds:
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str], single: np.ndarray) -> list[bytes]:
        """Ids of distinct words, each after a space, or after a line end where it begins with one."""
        raws = list(map(self.known.get, words))
        tokenize, letters, space, rest = self.library.model.tokenize, self.letters, self.letters[32], []
        for k in [k for k, r in enumerate(raws) if r is None]:
            w = words[k]
            if not single[k]:
                rest.append(k)
                continue
            w = w if w.isascii() else "".join([letters[b] for b in w.encode()])
            if words[k][0] == "\n":
                raws[k] = self.newline + array("I", [t.id for t in tokenize(w[1:] if w[0] == "\n" else w[len(letters[10]) :])]).tobytes()
            else:
                raws[k] = array("I", [t.id for t in tokenize(space + w)]).tobytes()
        for k, e in zip(rest, self.library.encode_batch_fast([words[k][1:] if words[k][:1] == "\n" else " " + words[k] for k in rest], add_special_tokens=False)):
            raws[k] = (self.newline if words[k][:1] == "\n" else b"") + array("I", e.ids).tobytes()
        if len(self.known) > MEMO:
            self.known = {}
        self.known.update(zip(words, raws))
        return raws

    def entries(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of distinct words."""
        core = pc.utf8_rtrim(words, characters=MARKS)
        core = pc.if_else(pc.match_substring_regex(core, r"\p{L}$"), core, words)
        cut = pc.not_equal(pc.binary_length(core), pc.binary_length(words))
        tails = [w[n:] for w, n in zip(words.filter(cut).to_pylist(), pc.utf8_length(core.filter(cut)).to_pylist())]
        marks = sorted(set(tails))
        mark = np.zeros(len(words), np.int64)
        at = {m: k + 1 for k, m in enumerate(marks)}
        mark[np.flatnonzero(cut.to_numpy(zero_copy_only=False))] = [at[m] for m in tails]
        core = core.dictionary_encode()
        names = core.dictionary
        raws = self.learn(names.to_pylist(), pc.match_substring_regex(names, r"^\n?\p{L}+$").to_numpy(zero_copy_only=False))
        raws += [b"", *map(self.whole, marks)]
        counts = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        order = np.stack([core.indices.to_numpy().astype(np.int64), mark + len(names)], axis=1)
        ids, n = gathered(np.frombuffer(b"".join(raws), "<u4"), np.cumsum(counts) - counts, counts, order.ravel())
        return ids, n.reshape(-1, 2).sum(axis=1)

    def encoded(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, end_id after each, and the lengths of their runs; a null text has the end alone."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(texts, ODD) if self.cuttable else pc.is_valid(texts)
        body = pc.if_else(odd, "", texts)
        body = pc.if_else(pc.match_substring_regex(body, UNEVEN), body, pc.replace_substring(body, "\n", " \n"))
        # every text starts with a line end, like the lines in it; its id makes room for the end id
        cut = pc.split_pattern(pc.binary_join_element_wise("", body, "\n"), " ")
        words = cut.flatten().dictionary_encode()
        ids, counts = self.entries(words.dictionary) if self.cuttable else (np.frombuffer(self.newline, "<u4"), np.array([len(self.newline) // 4]))
        order = words.indices.to_numpy().astype(np.int64)
        heads = cut.offsets.to_numpy().astype(np.int64)
        heads = heads - heads[0]
        alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(alone):
            raws = [self.newline + self.whole(t) for t in texts.take(pa.array(alone)).to_pylist()]
            order[heads[alone]] = len(counts) + np.arange(len(alone))
            ids = np.concatenate([ids, np.frombuffer(b"".join(raws), "<u4")])
            counts = np.concatenate([counts, np.fromiter(map(len, raws), np.int64, len(raws)) // 4])
        out, n = gathered(ids, np.cumsum(counts) - counts, counts, order)
        sizes = np.add.reduceat(n, heads[:-1]) if len(texts) else np.zeros(0, np.int64)
        lead = len(self.newline) // 4
        starts = np.cumsum(sizes) - sizes
        if lead > 1:
            extra = (starts[:, None] + np.arange(1, lead)).ravel()
            out, sizes = np.delete(out, extra), sizes - (lead - 1)
            starts = np.cumsum(sizes) - sizes
        out[starts] = end_id
        return (np.append(out[1:], np.uint32(end_id)) if len(out) else out).astype("<u4"), sizes

    def all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of some texts as little-endian 32-bit numbers; none for a null text."""
        ids, sizes = self.encoded(pa.array(texts, pa.string()), 0)
        ends = np.cumsum(sizes)
        return [ids[e - n : e - 1].tobytes() for e, n in zip(ends, sizes)]

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]


def _segment(part: int, number: int, before: int, docs: list[int], lengths: np.ndarray, ids: np.ndarray) -> dict:
    table = normalised(np.bincount(ids))
    ends = np.cumsum(lengths)
    blocks, i = [], 0
    while i < len(docs):
        start = int(ends[i] - lengths[i])
        j = min(len(docs), int(np.searchsorted(ends, start + BLOCK_IDS)) + 1)
        own = ids[start : ends[j - 1]]
        blocks.append({"doc_ids": docs[i:j], "lengths": lengths[i:j].tolist(), "n_ids": len(own), "payload": encode_block(own, table)})
        i = j
    return {"part": part, "segment": number, "before": before, "n_ids": len(ids), "coding": pack_table(*table), "blocks": blocks}


def _slices(batch: pa.RecordBatch, limit: int):
    """Parts of a batch with texts of about so many bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("coding", pa.binary()),
    ("blocks", pa.list_(pa.struct([
        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())]))),
])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id to each document and write the store, in ascending id order.

    A null or empty text has the end id alone. Rows that repeat an id are kept, in order of their text; a null
    id comes first. An empty table makes an empty store. Other columns are ignored.
    """
    def run(batches):
        encode, part = TextIds.of(tokenizer), TaskContext.get().partitionId()
        docs, sizes, ids, held, before, number = [], [], [], 0, 0, 0

        def segment():
            nonlocal docs, sizes, ids, held, before, number
            row = _segment(part, number, before, docs, np.concatenate(sizes), np.concatenate(ids))
            docs, sizes, ids, before, number, held = [], [], [], before + held, number + 1, 0
            return pa.RecordBatch.from_pylist([row], ARROW)

        for b in batches:
            for some in _slices(b, SLICE):
                got, n = encode.encoded(some.column("text"), end_id)
                names, ends, i = some.column("id").to_pylist(), np.cumsum(n), 0
                while i < len(n):
                    done = int(ends[i - 1]) if i else 0
                    j = min(len(n), int(np.searchsorted(ends, done + SEGMENT_IDS - held)) + 1)
                    docs += names[i:j]
                    sizes.append(n[i:j])
                    ids.append(got[done : ends[j - 1]])
                    held += int(ends[j - 1]) - done
                    i = j
                    if held >= SEGMENT_IDS:
                        yield segment()
        if docs:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, SCHEMA).write.parquet(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row per block, with the number of ids before its segment."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # parts are the range partitions of the writing job: 16 bytes each, as many as that job had tasks
    return segments.join(F.broadcast(parts.select("part", base.alias("base"))), "part").select(
        (F.col("base") + F.col("before")).alias("start"), "coding", F.col("blocks"))


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a store; with digest ids_crc32 in place of ids.

    start counts the ids of all documents before; ids_crc32 is over the ids as little-endian 32-bit numbers.
    """

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                table, at = Table(b.column("coding")[k].as_py()), b.column("start")[k].as_py()
                for block in b.column("blocks")[k]:
                    ids = decode_block(block["payload"].as_py(), table).astype("<u4")
                    docs, n = block["doc_ids"].values, block["lengths"].values.to_numpy()
                    ends = np.cumsum(n)
                    if digest:
                        raw = memoryview(ids.tobytes())
                        value = pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends - n, ends)], pa.int64())
                    else:
                        value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.record_batch([docs, pa.array(at + ends - n), pa.array(n), value], names=["doc_id", "start", "n_tokens", "v"])
                    at += int(ends[-1])

    kind = "long" if digest else "array<int>"
    out = _blocks(spark, path).mapInArrow(run, f"doc_id long, start long, n_tokens long, v {kind}")
    return out.withColumnRenamed("v", "ids_crc32" if digest else "ids")
