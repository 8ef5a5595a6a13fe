"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents in hash order, cut into blocks of equally many
words (the last may be shorter).  A target of so many words takes all blocks of as many whole
epochs as it holds, and of one more epoch the first blocks of a seeded permutation; the last of them
is used in part, so that the words come out exactly.  That is the source's quota of blocks.  A
binary tree over the output shards splits the vector of quotas by multivariate-hypergeometric draws,
so that shards differ only by chance and quotas are used up exactly.  Each shard then draws its own
interval of every source's blocks in the order of a second permutation, and shuffles its blocks
locally.  What a document contributes is what the shards drew of it.

Permutations are swap-or-not shuffles: a block finds its place by itself, from its number alone, so
no list of blocks is held or sorted anywhere.

Scale: texts are read once, to count words.  What is shuffled after that is a few
dozen bytes a document, and equal rows (such as many without an id) are one row with a count
meanwhile.  Offsets in a stream are running sums within (source, bucket), plus the sums of whole
buckets, so that a source with a third of all rows is spread over many tasks.  The driver holds one
row a source and shard.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle, small_batches
from .text import Words, chunks

#: A block has at least so many words, and more where a mix would have over MOST_BLOCKS.
BLOCK_WORDS, MOST_BLOCKS = 4096, 1 << 28
#: About so many documents share a bucket of a source's order; more equal rows than this are dealt out before they are
#: made rows again.
BUCKET_ROWS = 2_000
#: Rounds of a permutation.
ROUNDS = 32


@dataclass
class Mixture:
    """``documents``: doc_id, source, size, source_size, target, taken, pieces (array of
    struct(epoch, block, shard, first_word, n_words)).  ``plan``: one row a source with its
    blocks, its quota and how the tree dealt it to the shards.  ``shards``: how many."""

    documents: DataFrame
    plan: list[dict]
    shards: int
    seed: int

    def pieces(self) -> DataFrame:
        """One row per drawn piece of a document: shard, place (local shuffle order), doc_id, source, epoch, block, first_word, n_words."""
        one = self.documents.select("doc_id", "source", F.explode("pieces").alias("p")).select("doc_id", "source", "p.*")
        place = F.xxhash64(F.lit(self.seed), F.col("shard"), "source", "block")
        return one.select("shard", place.alias("place"), "doc_id", "source", "epoch", "block", "first_word", "n_words")


def count_words(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words of each text; 0 for null or empty."""
    small_batches(docs.sparkSession)
    schema = docs.select("doc_id", "source").schema.add("size", "long")

    def count(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(Words(b.column(2)).counts, pa.int64())], ["doc_id", "source", "size"])

    return docs.select("doc_id", "source", F.col("text").cast("string").alias("text")).mapInArrow(count, schema)


def shares(sizes: Mapping, weights: Mapping, cap: float) -> dict:
    """Target of each source: its weight's share of all sizes, at most cap times its size; the excess is shared again by weight."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if total and left * weights[s] / total > cap * sizes[s]]
        if not over:
            for s in open_:
                target[s] = left * weights[s] / total if total else 0.0
            break
        for s in over:
            target[s] = float(cap * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def deal(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Split block quotas (one a source) among shards; row k is shard k's share.  Columns sum to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        low, high, quota = stack.pop()
        if high - low == 1:
            out[low] = quota
            continue
        mid = (low + high) // 2
        take = int(quota.sum()) * (mid - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(quota, take, method="marginals") if take else np.zeros_like(quota)
        stack += [(low, mid, left), (mid, high, quota - left)]
    return out


def permuted(x: Column, n: Column, rounds: Column) -> Column:
    """The place of x in a permutation of 0..n-1: in each round, x and its mirror image change places or stay, by a bit that
    both have in common.  ``rounds`` has struct(k, salt): a centre of reflection below n, and what the bit depends on."""

    def turn(x, r):
        y = F.pmod(r["k"] - x, n)
        return F.when(F.xxhash64(r["salt"], F.greatest(x, y)) % 2 == 0, x).otherwise(y)

    return F.aggregate(rounds, x.cast("long"), turn)


def _rounds(rng: np.random.Generator, n: int) -> list[tuple[int, int]]:
    return [(int(k), int(salt)) for k, salt in zip(rng.integers(0, max(n, 1), ROUNDS), rng.integers(0, 1 << 62, ROUNDS))]


def _plan(spark, names: list, sizes: Mapping, target: Mapping, shards: int, seed: int) -> list[dict]:
    """One row a source: its blocks, how many are drawn, and the shards' intervals."""
    words = {s: int(round(target[s])) for s in names}
    block = max(BLOCK_WORDS, -(-sum(words.values()) // MOST_BLOCKS))
    plan = []
    for i, s in enumerate(names):
        rng = np.random.default_rng([seed, 1, i])
        blocks = -(-sizes[s] // block)
        epochs, rest = divmod(words[s], sizes[s]) if sizes[s] else (0, 0)
        plan.append({"source": s, "source_size": int(sizes[s]), "target": float(target[s]), "words": words[s], "block": block, "blocks": blocks, "epochs": epochs, "rest": rest, "draw": _rounds(rng, blocks)})
    # where the last, shorter block of each source stands in the permutation of the epoch that is drawn from
    rows = [(i, p["blocks"], p["draw"]) for i, p in enumerate(plan) if p["blocks"]]
    table = spark.createDataFrame(rows, "i int, n long, draw array<struct<k:long,salt:long>>") if rows else None
    at = {r["i"]: r["at"] for r in table.select("i", permuted(F.col("n") - 1, F.col("n"), F.col("draw")).alias("at")).collect()} if rows else {}
    for i, p in enumerate(plan):
        p["short"], p["short_at"] = p["blocks"] * block - p["source_size"], int(at.get(i, 0))
        drawn = -(-p["rest"] // block)
        if p["short_at"] < drawn and drawn * block - p["short"] < p["rest"]:
            drawn += 1
        p["quota"] = p["epochs"] * p["blocks"] + drawn
    dealt = deal(np.array([p["quota"] for p in plan], np.int64), shards, seed) if plan else np.zeros((shards, 0), np.int64)
    for i, p in enumerate(plan):
        p["order"] = _rounds(np.random.default_rng([seed, 2, i]), p["quota"])
        p["bounds"] = [int(x) for x in np.cumsum(dealt[:, i])]
    return plan


PLAN = "m_source string, source_size long, target double, m_words long, m_block long, m_blocks long, m_epochs long, m_rest long, m_draw array<struct<k:long,salt:long>>, m_short long, m_short_at long, m_quota long, m_order array<struct<k:long,salt:long>>, m_bounds array<long>"
PIECE = "struct<epoch:int,block:bigint,shard:int,first_word:bigint,n_words:bigint>"


def _pieces() -> Column:
    """What shards draw of a document whose words begin at m_start of its source's stream."""
    start, size, block, blocks = F.col("m_start"), F.col("size"), F.col("m_block"), F.col("m_blocks")
    quota, bounds = F.col("m_quota"), F.col("m_bounds")

    def of(epoch, b):
        whole = epoch < F.col("m_epochs")
        place = permuted(b, blocks, F.col("m_draw"))
        # words of the blocks that stand before this one in the epoch that is drawn from
        before = place * block - F.when(F.col("m_short_at") < place, F.col("m_short")).otherwise(0)
        end = F.when(whole, block).otherwise(F.least(block, F.greatest(F.col("m_rest") - before, F.lit(0)))) + b * block
        unit = F.col("m_epochs") * blocks + place
        low, high = F.greatest(start, b * block), F.least(start + size, (b + 1) * block, end)
        number = F.when(whole, epoch * blocks + b).otherwise(unit)
        shard = F.size(F.filter(bounds, lambda c: c <= permuted(number, quota, F.col("m_order"))))
        piece = F.struct(epoch.cast("int").alias("epoch"), (epoch * blocks + b).alias("block"), shard.alias("shard"), (low - start).alias("first_word"), (high - low).alias("n_words"))
        return F.when(high > low, piece)

    mine = F.sequence(F.floor(start / block), F.floor((start + size - 1) / block))
    every = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("m_epochs")), lambda e: F.transform(mine, lambda b: of(e, b))))
    # a block beyond the last bound was given to no shard
    drawn = F.filter(every, lambda p: p.isNotNull() & (p["shard"] < F.size(bounds)))
    return F.when((size > 0) & (quota > 0), drawn).otherwise(F.expr(f"cast(array() as array<{PIECE}>)"))


def _rows_again(groups: DataFrame) -> DataFrame:
    """A row for each of m_copies equal rows, m_start moved on by size; large groups are dealt out first."""

    def copies(df, first, many):
        return df.withColumn("m_copy", F.explode(F.sequence(first, many))).withColumn("m_start", F.col("m_start") + F.col("m_copy") * F.col("size"))

    few = copies(groups.where(F.col("m_copies") <= BUCKET_ROWS), F.lit(0).cast("long"), F.col("m_copies") - 1)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m_copies") - 1) / BUCKET_ROWS)))
    many = groups.where(F.col("m_copies") > BUCKET_ROWS).withColumn("m_part", part).repartition("m_source", "doc_id", "size", "m_part")
    many = copies(many, F.col("m_part") * BUCKET_ROWS, F.least(F.col("m_copies"), (F.col("m_part") + 1) * BUCKET_ROWS) - 1).drop("m_part")
    return few.unionByName(many).drop("m_copy")


def mix_sources(docs: DataFrame, weights: Mapping | None = None, cap: float = 3.0, shards: int = 64, seed: int = 17) -> Mixture:
    """Mix ``docs`` (doc_id, source, text) to the given weights by source.

    Without weights, sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...  No
    source, and so no document, is repeated more than ``cap`` times.

    Defined results: null or empty text has size 0 and gives no piece; null is a source of its
    own; a null doc_id is a document like others; equal rows each take their own part of the
    stream; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    table = settle(count_words(docs), "mix-sizes")
    totals = {r["source"]: (r["s"] or 0, r["n"]) for r in table.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    names = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    sizes = {s: totals[s][0] for s in names}
    weights = {s: weights.get(s, 0) for s in names} if weights is not None else {s: i % 3 + 1 for i, s in enumerate(names)}
    plan = _plan(spark, names, sizes, shares(sizes, weights, cap), shards, seed)
    columns = ("source", "source_size", "target", "words", "block", "blocks", "epochs", "rest", "draw", "short", "short_at", "quota", "order", "bounds")
    per_source = F.broadcast(spark.createDataFrame([tuple(p[c] for c in columns) for p in plan], PLAN))
    buckets = max(1, -(-sum(n for _, n in totals.values()) // BUCKET_ROWS))
    groups = table.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m_copies"))
    keyed = groups.withColumn("m_key", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("m_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "m_key"), F.lit(buckets)))
    words = F.col("size") * F.col("m_copies")
    sums = keyed.groupBy(F.col("source").alias("b_source"), F.col("m_bucket").alias("b_bucket")).agg(F.sum(words).alias("b_size"))
    sums = sums.withColumn("b_start", F.sum("b_size").over(Window.partitionBy("b_source").orderBy("b_bucket")) - F.col("b_size")).drop("b_size")
    inner = F.sum(words).over(Window.partitionBy("source", "m_bucket").orderBy("m_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - words
    placed = keyed.withColumn("m_inner", inner).join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("m_bucket") == F.col("b_bucket")))
    placed = placed.join(per_source, F.col("source").eqNullSafe(F.col("m_source"))).withColumn("m_start", F.col("m_inner") + F.col("b_start"))
    out = _rows_again(placed).withColumn("pieces", _pieces())
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n_words"])
    return Mixture(out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "pieces"), plan, shards, seed)


def _listed(mix: Mixture) -> DataFrame:
    """The documents of a mixture with ``shards``: the shards that drew of each, in order, as shard:words, comma-joined."""
    numbers = F.array_sort(F.array_distinct(F.transform("pieces", lambda p: p["shard"])))
    words = lambda k: F.aggregate(F.filter("pieces", lambda p: p["shard"] == k), F.lit(0).cast("long"), lambda a, p: a + p["n_words"])
    listed = F.array_join(F.transform(numbers, lambda k: F.concat(k.cast("string"), F.lit(":"), words(k).cast("string"))), ",")
    return mix.documents.select("doc_id", "source", "size", "source_size", "target", "taken", listed.alias("shards"))


def mixing_query(spark, sf_dir: str) -> DataFrame:
    """op1: size, source_size, target and taken of every document, from the pieces that shards drew, and these shards."""
    return _listed(mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: mix what is left to the default weights; one row a document with the words that shards drew of it."""
    return _listed(mix_sources(docs))
