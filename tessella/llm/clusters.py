"""Verifying candidate clusters exactly, without a row for each pair.

Any two items that may be linked are in one candidate cluster.  Clusters are packed into tasks of
bounded weight; a cluster heavier than that is cut into chunks, and each pair of chunks is a task.
A task finds all links between its items but returns only a spanning forest of them, so rows
stay linear while no link is lost for the components.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight (tokens) of a task's items.
TASK_WEIGHT = 1_500_000


class Forest:
    """Union-find over 0..n-1 that keeps labels in an array, so that whole rows can be compared."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}
        self.edges: list[tuple[int, int]] = []
        self.parts = n

    def join(self, i: int, j: int) -> bool:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return False
        ma, mb = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(ma) < len(mb):
            a, ma, mb = b, mb, ma
        self.label[mb] = a
        ma.extend(mb)
        self.members[a] = ma
        self.edges.append((i, j))
        self.parts -= 1
        return True


def verified_links(items: DataFrame, find: Callable[[pa.Table, np.ndarray, Forest], None] | None, weight: int = TASK_WEIGHT, *, find_all: Callable | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """a, b: a spanning forest of the links within each cluster.

    ``items`` has cluster and id (long), weight (long) and what ``find`` needs.  ``find(table, sides,
    forest)`` gets one cluster's items, or two chunks of it, and joins linked items; ``sides`` tells
    the chunk of each item, and only pairs of different sides need looking at when there are two.
    Or ``find_all(table, edges, sides)`` gets all clusters of a task, which begin at ``edges``, and returns the ids of
    linked items as two lists.  ``bodies`` has id and what is too heavy to come with each row of ``items``; a task gets it once an item.
    """
    sizes = items.groupBy("cluster").agg(F.sum("weight").alias("total"), F.count("*").alias("n")).where("n > 1")
    bins = max(1, -(-(sizes.agg(F.sum("total")).first()[0] or 0) // weight))
    chunks = F.ceil(F.col("total") / weight).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("chunks")).cast("int")
    dealt = items.join(sizes.select("cluster", chunks.alias("chunks")), "cluster").withColumn("side", F.when(F.col("chunks") > 1, mine).otherwise(F.lit(0)))
    every = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.xxhash64("cluster", F.least("side", o), F.greatest("side", o)))
    task = F.explode(F.when(F.col("chunks") > 1, every).otherwise(F.array(F.pmod(F.xxhash64("cluster"), F.lit(bins)))))

    nested = bodies is not None

    def run(table: pa.Table) -> pa.Table:
        if nested:
            table = table.combine_chunks()
            of = table.column("of").combine_chunks()
            table = table.drop_columns(["of"]).take(pc.list_parent_indices(of))
            for i, c in enumerate(("cluster", "side")):
                table = table.append_column(c, of.flatten().field(i))
        table = table.sort_by("cluster").combine_chunks()
        clusters, every, side = (table.column(c).to_numpy() for c in ("cluster", "id", "side"))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(clusters)) + 1, [len(clusters)]]).tolist()
        if find_all is not None:
            a, b = find_all(table, edges, side)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        a, b = [], []
        for low, high in zip(edges, edges[1:]):
            if high - low < 2:
                continue
            forest = Forest(high - low)
            find(table.slice(low, high - low), side[low:high], forest)
            a += [int(every[low + i]) for i, _ in forest.edges]
            b += [int(every[low + j]) for _, j in forest.edges]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = dealt.withColumn("task", task)
    if nested:
        rest = [F.first(c).alias(c) for c in items.columns if c not in ("cluster", "id")]
        dealt = dealt.groupBy("task", "id").agg(F.collect_list(F.struct("cluster", "side")).alias("of"), *rest).join(bodies, "id")
    return dealt.groupBy("task").applyInArrow(run, "a long, b long")
