"""A Bloom filter of fixed size, built by slices on the executors.

It only thins out what a scan emits: what passes wrongly is dropped by a later exact step, so
its size (8 MB, broadcast) never decides a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import pack, unpack
from .text import mix

BITS, SLICES = 1 << 26, 64
SLICE = BITS // SLICES


def _positions(keys: np.ndarray) -> np.ndarray:
    return np.stack([mix(keys, 11 + i) >> np.uint64(38) for i in range(3)])


def build(keys: DataFrame) -> np.ndarray:
    """``keys`` has one long column.  The bits, as bytes."""

    def cut(batches):
        for batch in batches:
            at = np.unique(_positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            edges = np.searchsorted(at, np.arange(SLICES + 1, dtype=np.uint64) * np.uint64(SLICE))
            rows = [(s, pack(at[i:j] - np.uint64(s * SLICE), True)) for s, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        bits = np.zeros(SLICE, bool)
        for raw in table.column("bits"):
            bits[unpack(raw.as_py()).astype(np.int64)] = True
        return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros(BITS // 8, np.uint8)
    for r in keys.mapInArrow(cut, "slice int, bits binary").groupBy("slice").applyInArrow(unite, "slice int, bits binary").collect():
        out[r[0] * SLICE // 8 : (r[0] + 1) * SLICE // 8] = np.frombuffer(r[1], np.uint8)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _positions(keys)
    return ((bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(0)


def flag(bits):
    """A function of a long column: may the filter (broadcast) hold the key."""

    @F.pandas_udf("boolean")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits.value, keys.to_numpy(np.int64).view(np.uint64)))

    return run
