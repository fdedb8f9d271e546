"""Vectorised helpers over Arrow text columns: bytes, words, and 64-bit word hashes in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; nothing else is normalised.
Words never become Python strings: a polynomial prefix sum over the byte buffer gives the hash of every
word in a handful of array operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Multiplier of the polynomial hash and its inverse modulo 2**64.
MULT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are taken in slices of about so many bytes, so that work arrays stay small whatever the batch.
SLICE = 1 << 20
#: Where stages follow each other in the same workers, slices are smaller: work arrays take 8 bytes and more for a byte of text.
SMALL_SLICE = 1 << 18

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of MULT and of its inverse; those of a slice are kept, those of a longer text are not."""
    if len(_powers["up"]) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    size, made = max(n, SLICE + (SLICE >> 3)), {}
    for kind, base in (("up", MULT), ("down", INVERSE)):
        a = np.full(size, base, dtype=np.uint64)
        a[0] = 1
        made[kind] = np.multiply.accumulate(a)
    if size <= SLICE + (SLICE >> 3):
        _powers.update(made)
    return made["up"][:n], made["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def give_back() -> None:
    """Memory that is free goes back to the system: a worker that waits for its next stage holds none of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def byte_slices(col: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; a null text is empty. Gives memory back at the end."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_string() if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else pa.large_binary())
    if not len(col):
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    give_back()


def word_bounds(buf: np.ndarray, offs: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of some texts, and for each text the index of its first word.

    apart: which bytes separate words; white space by default.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~apart[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < len(buf))]
    start[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    up, down = powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text, and per text the index of its first shingle.

    A text of one to n-1 words has one shingle of all its words; a text without words has none.
    """
    counts = np.diff(first)
    up, _ = powers(n)
    out = np.zeros(len(hashes), dtype=np.uint64)
    keep = np.zeros(len(hashes), dtype=bool)
    if len(hashes) >= n:
        m = len(hashes) - n + 1
        acc = hashes[:m] * up[0]
        for k in range(1, n):
            acc = acc + hashes[k : k + m] * up[k]
        left = np.repeat(first[1:], counts) - np.arange(len(hashes))  # words from here to the end of the text
        out[:m] = acc
        keep[:m] = left[:m] >= n
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        i, j = first[d], first[d + 1]
        out[i] = (hashes[i:j] * up[: j - i]).sum(dtype=np.uint64) + np.uint64(j - i)
        keep[i] = True
    return mix(out[keep]), np.concatenate([[0], np.cumsum(keep)])[first]


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[starts : starts + counts] that order names, one after the other, and their lengths."""
    n = counts[order]
    ends = np.cumsum(n)
    return values[np.repeat(starts[order] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n
