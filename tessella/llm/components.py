"""Connected components of an edge table by local forests and alternating stars.

Edges are dealt into tasks of bounded size; each task replaces its edges by stars of its own components,
which leaves fewer edges and short paths.  Where all edges fit one task, that is the answer.  Beyond
that, rounds of large and small stars go on from there.  Edges never go to the driver, and a vertex with
many edges is a hot key only in joins that adaptive execution can split and in sums that are combined
before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, settle

#: Edges that one task takes at most (some 50 MB).
TASK_EDGES = 1_000_000


def local_stars(batches):
    """One row (v, root) for every vertex of the task's edges that isn't the smallest of its component there."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
    if not a:
        return
    a, b = np.concatenate(a), np.concatenate(b)
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(ids)).tolist()
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array(parent, np.int64)
    while len(root) and (root[root] != root).any():
        root = root[root]
    inner = root != np.arange(len(root))
    for low in range(0, int(inner.sum()), 100_000):
        v = np.flatnonzero(inner)[low : low + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[v]), pa.array(ids[root[v]])], ["u", "v"])


def _star_round(edges: DataFrame) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    both = edges.unionAll(edges.select(v.alias("u"), u.alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where(v > F.col("m")).select(v.alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return small.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int | None = None) -> DataFrame:
    """id, root: for every vertex with an edge, the smallest vertex of its component (roots included).

    ``edges`` has two long columns; direction, loops and repeats don't matter.
    """
    most = task_edges or TASK_EDGES
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), "edges")
    count, state = now.count(), None
    while True:
        tasks = -(-count // most)
        dealt = now.repartition(max(1, tasks))
        stars = dealt.mapInArrow(local_stars, "u long, v long")
        after = settle(stars if tasks <= 1 else _star_round(stars), "edges")
        discard(now)
        now = after
        if tasks <= 1:
            break
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, total) == state:
            break
        state = (count, total)
    out = now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    out._tessella_path = now._tessella_path  # noqa: SLF001  so that ``discard`` takes the result too
    return out
