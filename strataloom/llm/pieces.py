"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces runs once over a word; at each position its output links give every
piece that ends there, and the best way to reach each position is kept (Viterbi). What "best" means follows
the model:

* unigram: the largest sum of piece scores, an unknown character costing the least score less 10;
* BPE: the segmentation that the model's merges lead to. The sum of scores alone does not give it. But of the
  pieces that end at a position exactly one can follow the segmentation of what stands before it, the one whose
  pair with the last piece there stays apart when merged; all others count as minus infinity. So the same pass
  relaxes the same sums under that condition, and the ids equal those of the sentencepiece library.

Pieces never hold a space mark after another character, so texts are cut into words before space marks and at
line ends; Arrow dictionaries find equal words, and the ids of short words are remembered in a bounded memo.
Whole texts are encoded. A worker holds one slice of texts and the memos, some 100 MB.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.textkit import SMALL_SLICE, byte_slices, gathered

MARK = "▁"
RUNS = re.compile(r" *[^ ]+| +$")
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Texts with these are cut by Python: runs of spaces, and spaces at an end of a text or before a line end.
RUNS_OF_SPACES = r"  |^ | $| \n"
#: Words up to so many characters are remembered, and so many words and pairs of pieces; then the memo starts anew.
SHORT, WORDS, PAIRS = 40, 200_000, 400_000


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message, as far as they are integers or bytes."""
    i = 0

    def varint():
        nonlocal i
        v = s = 0
        while True:
            b = raw[i]
            i += 1
            v |= (b & 127) << s
            s += 7
            if b < 128:
                return v

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, raw[i : i + n]
            i += n
        else:
            i += 8 if key & 7 == 1 else 4


class Pieces:
    """A model file: its pieces, and encoding and decoding of texts."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        model = list(_fields(lib.serialized_model_proto()))
        trainer = dict(_fields(next((v for k, v in model if k == 2), b"")))
        norm = dict(_fields(next((v for k, v in model if k == 3), b"")))
        self.kind = trainer.get(3, UNIGRAM)
        self.dummy_prefix = bool(norm.get(3, 1))
        if norm.get(2) or norm.get(4, 1):
            raise ValueError("only models with identity normalisation that keep all spaces are supported")
        self.unk = lib.unk_id()
        self.bytes_of = [names[i].replace(MARK, " ").encode() for i in range(n)]
        self.byte_id = [self.unk] * 256
        self.ids, self.scores = {}, {}
        for i in range(n):
            if lib.is_byte(i):
                value = int(names[i][3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif lib.is_control(i):
                self.bytes_of[i] = b""
            elif not (lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[names[i]], self.scores[names[i]] = i, lib.get_score(i)
        self.fallback = any(x != self.unk for x in self.byte_id)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece runs over the start of a word or line")
        self.names = names
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        if self.ids:
            self.automaton.make_automaton()
        self.least = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.score_of = [self.scores.get(name, 0.0) for name in names]
        self.segment = self.by_score if self.kind == UNIGRAM else self.by_merges
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.newline = np.array(self.unknown("\n"), "<i4").tobytes()
        sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.table = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(sizes) - sizes, sizes

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def unknown(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode()] if self.fallback else [self.unk]

    def by_score(self, word: str) -> list[int]:
        """Viterbi over the pieces that the automaton finds, by sums of scores; the longer piece wins a tie."""
        n = len(word)
        best, back = [0.0] + [-np.inf] * n, [(-1, 1)] * (n + 1)
        reached, score = 0, self.score_of
        for end, (i, size) in self.automaton.iter(word):
            while reached < end:  # an unknown character, where no piece ends
                reached += 1
                if best[reached] == -np.inf:
                    best[reached] = best[reached - 1] + self.least
            s = best[end + 1 - size] + score[i]
            if s > best[end + 1]:
                best[end + 1], back[end + 1] = s, (i, size)
        return self._walk_back(word, back)

    def _walk_back(self, word: str, back: list[tuple[int, int]]) -> list[int]:
        out, at = [], len(word)
        while at:
            i, size = back[at]
            if i >= 0:
                out.append(i)
            else:
                out += reversed(self.unknown(word[at - 1]))
            at -= size
        out.reverse()
        return out

    def by_merges(self, word: str) -> list[int]:
        """The same pass under the condition that the last piece and the next stay apart.

        A piece that may not follow counts as minus infinity. One piece at most may, so a position that has its
        best sum needs no further link. Runs of space marks, which pieces may cut anywhere, are merged directly.
        """
        if word[:2] == MARK * 2:
            return [x for p in self.merged(word) for x in ([self.ids[p]] if p in self.ids else self.unknown(p))]
        n, many = len(word), len(self.names)
        best, back = [0.0] * (n + 1), [(-1, 1)] * (n + 1)
        score, apart = self.score_of, self.pairs.get
        for end, (i, size) in self.automaton.iter(word):
            end += 1
            if back[end][0] < 0:
                at = end - size
                before = back[at][0]  # -1: the start, or an unknown character, which nothing merges with
                follows = apart((before + 1) * many + i)
                if follows is None:
                    follows = self._stay_apart(before, i)
                if follows:
                    best[end], back[end] = best[at] + score[i], (i, size)
        return self._walk_back(word, back)

    def merged(self, text: str) -> list[str]:
        """Merge by merge: the neighbours whose joint piece has the best score, leftmost first."""
        parts, n, scores = list(text), len(text), self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, k, 2) for k in range(n - 1) if (s := scores.get(parts[k] + parts[k + 1])) is not None]
        heapify(heap)
        while heap:
            _, a, size = heappop(heap)
            b = after[a]
            if not parts[a] or b >= n or len(parts[a]) + len(parts[b]) != size:
                continue  # one of the two has been merged since
            parts[a] += parts[b]
            parts[b] = ""
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y < n and (s := scores.get(parts[x] + parts[y])) is not None:
                    heappush(heap, (-s, x, len(parts[x]) + len(parts[y])))
        return [p for p in parts if p]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether piece b is whole after piece a; -1: at the start of a word."""
        want = [self.names[a], self.names[b]] if a >= 0 else [self.names[b]]
        got = self.merged("".join(want)) == want
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[(a + 1) * len(self.names) + b] = got
        return got

    def word(self, word: str) -> bytes:
        """Ids of a word after a space; a word that begins with a line end has its id and no space before it."""
        got = self.words.get(word)
        if got is None:
            if word[:1] == "\n":
                got = self.newline + array("i", self.segment(word[1:]) if word[1:] else []).tobytes()
            else:
                got = array("i", self.segment(MARK + word.replace(" ", MARK))).tobytes()
            if len(word) <= SHORT:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        out = []
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            parts = RUNS.findall(line if k or not self.dummy_prefix else " " + line)
            head = parts.pop(0) if parts and parts[0][0] != " " else ""
            if k:
                out.append(self.word("\n" + head))
            elif head:
                out.append(self.word("\n" + head)[len(self.newline) :])
            out += [self.word(w[1:]) for w in parts]
        return b"".join(out)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts and how many each has; a null text has none."""
        texts = texts.cast(pa.string()).fill_null("")
        body = pc.replace_substring(texts, MARK, " ")
        odd = pc.match_substring_regex(body, RUNS_OF_SPACES).to_numpy(zero_copy_only=False) | (not self.dummy_prefix)
        body = pc.if_else(pa.array(odd), "", body)
        cut = pc.split_pattern(pc.replace_substring(body, "\n", " \n"), " ")
        words = cut.flatten().dictionary_encode()
        raws = list(map(self.word, words.dictionary.to_pylist()))
        order = words.indices.to_numpy().astype(np.int64)
        heads = cut.offsets.to_numpy().astype(np.int64)
        heads = heads[:-1] - heads[0]
        # a text that is cut elsewhere, or empty, is one word here
        apart = np.flatnonzero(odd | (pc.binary_length(texts).to_numpy() == 0))
        order[heads[apart]] = len(raws) + np.arange(len(apart))
        raws += map(self.encode, texts.take(pa.array(apart)).to_pylist())
        counts = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        ids, n = gathered(np.frombuffer(b"".join(raws), "<i4"), np.cumsum(counts) - counts, counts, order)
        return ids, np.add.reduceat(n, heads) if len(heads) else np.zeros(0, np.int64)

    def decode(self, ids: bytes) -> str:
        return self.decode_all(np.frombuffer(ids, "<i4"), np.array([len(ids) // 4]))[0].decode()

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 texts of consecutive runs of ids."""
        raw, n = gathered(*self.table, ids.astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        starts = np.concatenate([[0], ends[:-1]])
        if self.dummy_prefix and len(raw):
            starts = starts + ((starts < ends) & (raw[np.minimum(starts, len(raw) - 1)] == 32))
        raw = raw.tobytes()
        texts = [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
        try:
            raw.decode()
        except UnicodeDecodeError:
            texts = [t.decode("utf-8", "replace").encode() for t in texts]
        return texts


def _shown(texts: list[bytes], digest: bool) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() if digest else t.decode() for t in texts], pa.string())


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, digest: bool = False) -> DataFrame:
    """(id, n_tokens, ids array<int>) of every row; a null or empty text has no ids.

    Space marks in a text count as spaces, as in the library. Repeated rows are encoded one by one, other
    columns are ignored, an empty table gives no rows. decoded adds what decode() makes of the ids, in the same
    pass over the texts.
    """
    column = "decoded_sha256" if digest else "text"

    def run(batches):
        pieces = Pieces.of(model)
        for b in batches:
            for i, j, _, _ in byte_slices(b.column("text"), SMALL_SLICE):
                ids, n = pieces.encode_all(b.column("text").slice(i, j - i))
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                out = [b.column("id").slice(i, j - i), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(ids))]
                if decoded:
                    out.append(_shown(pieces.decode_all(ids, n), digest))
                yield pa.record_batch(out, names=[id_col, "n_tokens", "ids", column][: len(out)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids array<int>" + f", {column} string" * decoded)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """(id, n_tokens, ids, text) from ids; with digest the lower-case hex sha256 of the text, decoded_sha256, in place of it.

    Null ids decode to the empty text.
    """
    column = "decoded_sha256" if digest else "text"

    def run(batches):
        pieces = Pieces.of(model)
        for b in batches:
            for c in range(0, b.num_rows, 1024):
                part = b.slice(c, 1024)
                own = part.column("ids")
                texts = pieces.decode_all(own.flatten().to_numpy(), pc.fill_null(pc.list_value_length(own), 0).to_numpy())
                yield pa.record_batch([part.column("id"), part.column("n_tokens"), own, _shown(texts, digest)], names=[id_col, "n_tokens", "ids", column])

    rows = encoded.select(F.col(id_col).alias("id"), "n_tokens", "ids")
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids array<int>, {column} string")
