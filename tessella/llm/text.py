"""Vectorised word and shingle views of Arrow string columns.

A chunk of documents is handled as one byte buffer: words are found with byte
masks (the separators are ASCII, so UTF-8 needs no decoding) and hashed with
prefix sums of a polynomial modulo 2**64.  No Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
_PIECE = 1 << 20
_ROOT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ROOT, -1, 1 << 64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CONTINUATION = np.zeros(256, bool)
CONTINUATION[0x80:0xC0] = True


def byte_class(chars: str) -> np.ndarray:
    """A 256-entry table that is true for the given ASCII characters."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice batches so that a slice holds about ``limit`` bytes of text, or one document."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low, n = 0, batch.num_rows
        while low < n:
            done = sizes[low - 1] if low else 0
            high = min(n, max(low + 1, int(np.searchsorted(sizes, done + limit, "right"))))
            yield batch.slice(low, high - low)
            low = high


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64, on a copy."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def _power_table(root: int, n: int) -> np.ndarray:
    have = _powers.get(root)
    if have is None or len(have) < n:
        have = np.full(max(n, _PIECE + 1), root, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[root] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _PIECE, "right")))
        base = int(starts[low])
        piece = data[base : int(ends[high - 1])].astype(np.uint64)
        piece += np.uint64(1)
        piece *= _power_table(_ROOT, len(piece))[: len(piece)]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece, out=total[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = (total[e] - total[s]) * _power_table(_INVERSE, len(piece))[s]
        low = high
    return mix(out ^ ((ends - starts).astype(np.uint64) << np.uint64(1)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    _, offs, raw = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross a document."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a chunk: byte spans and the word range of each document."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = buffers(column)
        if lower:
            self.data = LOWER[self.data]
        self.starts, self.ends = spans(~SEPARATOR[self.data], self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every k-word window that lies within one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= np.uint64(0xD6E8FEB86659FD93)
        acc += h[j : j + n]
    counts = np.diff(first)
    left = np.repeat(first[1:], counts)[:n]  # the end of each word's document
    at = np.flatnonzero(np.arange(n) + k <= left)
    return mix(acc[at], k), at


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted within it, and where each document's begin.

    A document with 1 to k-1 words has its whole sequence as its only shingle.
    """
    h = words.hashes()
    w, at = windows(h, words.first, k)
    docs = len(words.counts)
    owner = np.searchsorted(words.first, at, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for m in range(1, k):
            of = np.flatnonzero(words.counts[short] == m)
            acc = h[words.first[short[of]]].copy()
            for j in range(1, m):
                acc *= np.uint64(0xD6E8FEB86659FD93)
                acc += h[words.first[short[of]] + j]
            whole[of] = mix(acc, 1000 + m)
        w, owner = np.concatenate([w, whole]), np.concatenate([owner, short])
    order = np.lexsort((w, owner))
    w, owner = w[order], owner[order]
    if len(w):
        keep = np.empty(len(w), bool)
        keep[0] = True
        keep[1:] = (w[1:] != w[:-1]) | (owner[1:] != owner[:-1])
        w, owner = w[keep], owner[keep]
    return w, np.searchsorted(owner, np.arange(docs + 1))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each range [first[i], first[i+1]) of values."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype == np.uint64 or values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def binary_rows(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of values[first[i]:first[i+1]]."""
    raw = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    offs = pa.py_buffer((first.astype(np.int64) * values.dtype.itemsize).astype(np.int32).tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, offs, raw])
