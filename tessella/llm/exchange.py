"""Packed exchanges: sorted keys travel as compressed byte planes, one row a block and part.

Sending millions of (key, value) pairs as rows costs most of its time in the rows.  Here a
task sorts its keys, cuts them by key range into parts and sends one binary a part.
"""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray, deltas: bool = False) -> bytes:
    """Unsigned integers as byte planes, compressed; with ``deltas`` for sorted ones."""
    if deltas and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), width).T)
    return zstandard.ZstdCompressor(level=1).compress(bytes([width, deltas]) + planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    body = zstandard.ZstdDecompressor().decompress(raw)
    width, deltas = body[0], body[1]
    planes = np.frombuffer(body, np.uint8, offset=2).reshape(width, -1)
    values = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()
    return np.cumsum(values, dtype=values.dtype) if deltas else values


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted 64-bit keys: parts are equal ranges of the top 32 bits."""
    edges = (np.arange(parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts) << np.uint64(32)
    return np.concatenate([np.searchsorted(keys, edges, "left"), [len(keys)]])


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and for each key the index of its value."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys)
    s = keys[order]
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], inverse
