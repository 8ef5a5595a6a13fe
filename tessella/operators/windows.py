"""Training examples from token sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lm_windows(sequences: DataFrame, context: int, stride: int | None = None, column: str = "ids") -> DataFrame:
    """All other columns, start, x, y: windows of ``context`` ids and the same moved on by one.

    Starts are 0, stride, 2 stride, ... as long as y fits; a sequence of at most ``context`` ids has none.
    """
    ids, step = F.col(column), stride or context
    starts = F.when(F.size(ids) > context, F.sequence(F.lit(0), F.size(ids) - context - 1, F.lit(step)))
    rest = [c for c in sequences.columns if c != column]
    at = sequences.select(*rest, column, F.explode(starts).alias("start"))
    return at.select(*rest, "start", F.slice(ids, F.col("start") + 1, context).alias("x"), F.slice(ids, F.col("start") + 2, context).alias("y"))


def context_windows(sequences: DataFrame, context: int, column: str = "ids") -> DataFrame:
    """All other columns, start, and the ids of every window of ``context`` ids, one after the other; the last may be shorter.

    A sequence without ids has one row, of null start.
    """
    ids = F.col(column)
    starts = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1, F.lit(context)))
    rest = [c for c in sequences.columns if c != column]
    at = sequences.select(*rest, column, F.explode_outer(starts).alias("start"))
    return at.select(*rest, "start", F.slice(ids, F.col("start") + 1, context).alias(column))


def dataset(sequences: DataFrame, order: str, column: str = "ids") -> DataFrame:
    """pos, token_id: all sequences one after the other, by ``order`` and then by their ids.

    Only lengths are summed over all rows: the ids stay where they are, beside their sequence's offset.
    """
    from pyspark.sql import Window

    rows = sequences.where(F.col(column).isNotNull()).select(F.struct(order, column).alias("key"), F.size(column).cast("long").alias("n"))
    lengths = rows.groupBy("key").agg(F.sum("n").alias("total"))
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    first = lengths.select("key", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    copy = F.row_number().over(Window.partitionBy("key").orderBy("key")) - 1
    placed = rows.withColumn("copy", copy).join(first, "key").select((F.col("first") + F.col("copy") * F.col("n")).alias("offset"), F.col(f"key.{column}").alias("ids"))
    return placed.select("offset", F.posexplode("ids").alias("i", "token_id")).select((F.col("offset") + F.col("i")).alias("pos"), "token_id")


def random_batch(dataset: DataFrame, batch: int, context: int, seed: int, device: str = "cpu") -> DataFrame:
    """b, start, x, y: ``batch`` windows of a (pos, token_id) table from uniformly random starts.

    Only the rows of the windows are gathered: starts are few and are broadcast.
    """
    if device != "cpu":
        raise ValueError(f"no such device: {device}")
    n = dataset.count()
    if n <= context:
        raise ValueError("the dataset is no longer than the context")
    starts = np.random.default_rng(seed).integers(0, n - context, batch)
    chosen = dataset.sparkSession.createDataFrame([(b, int(s)) for b, s in enumerate(starts)], "b int, start long")
    offsets = chosen.select("b", "start", F.explode(F.sequence(F.lit(0), F.lit(context))).alias("o")).withColumn("pos", F.col("start") + F.col("o"))
    rows = dataset.join(F.broadcast(offsets), "pos")
    ids = rows.groupBy("b", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "token_id"))), lambda r: r["token_id"]).alias("ids"))
    return ids.select("b", "start", F.slice("ids", 1, context).alias("x"), F.slice("ids", 2, context).alias("y"))


def start_histogram(windows: DataFrame) -> DataFrame:
    """start, n, low, high: how often each start occurs and five standard deviations around its expectation."""
    counts = windows.groupBy("start").agg(F.count("*").alias("n"))
    total = windows.agg(F.count("*").alias("total"), F.countDistinct("start").alias("k"))
    p = F.lit(1.0) / F.col("k")
    spread = 5 * F.sqrt(F.col("total") * p * (1 - p))
    return counts.crossJoin(F.broadcast(total)).select("start", "n", (F.col("total") * p - spread).alias("low"), (F.col("total") * p + spread).alias("high"))


def speeds(blocks: DataFrame, key: str, order: str, amount: str, seconds: str) -> DataFrame:
    """All columns, speed, previous_speed and average_speed of timed blocks, within each key."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    speed = F.when(F.col(seconds) > 0, F.col(amount) / F.col(seconds))
    out = blocks.withColumn("speed", speed).withColumn("previous_speed", F.lag("speed").over(w))
    return out.withColumn("average_speed", F.when(F.sum(seconds).over(run) > 0, F.sum(amount).over(run) / F.sum(seconds).over(run)))


def time_shares(timers: DataFrame, key: str, seconds: str) -> DataFrame:
    """key, seconds, percent of all; 0 where nothing was timed."""
    by = timers.groupBy(key).agg(F.sum(seconds).alias("seconds"))
    all_ = by.agg(F.sum("seconds").alias("all_seconds"))
    return by.crossJoin(F.broadcast(all_)).select(key, "seconds", F.when(F.col("all_seconds") > 0, 100 * F.col("seconds") / F.col("all_seconds")).otherwise(0.0).alias("percent"))
