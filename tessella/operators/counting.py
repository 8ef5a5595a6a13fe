"""Counting words and pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pretokens import GPT2_PATTERN, pretokens, segments
from ..functions.words import adjacent_pairs, as_word, merge_pair


def token_counts(texts: DataFrame, column: str = "text", pattern: str = GPT2_PATTERN, special_tokens: Sequence[str] = (), least_bytes: int = 1) -> DataFrame:
    """token, cnt: how often each pre-token of at least so many bytes occurs.  Null texts have none; special tokens only separate."""
    parts = texts.select(F.explode(segments(F.col(column), special_tokens)).alias("part")) if special_tokens else texts.select(F.col(column).alias("part"))
    tokens = parts.select(F.explode(pretokens(F.col("part"), pattern)).alias("token"))
    if special_tokens:
        tokens = tokens.where(~F.col("token").isin(*special_tokens))
    if least_bytes > 1:
        tokens = tokens.where(F.octet_length("token") >= least_bytes)
    return tokens.groupBy("token").agg(F.count("*").alias("cnt"))


def word_counts(texts: DataFrame, **options) -> DataFrame:
    """word (bracketed hex bytes), cnt."""
    return token_counts(texts, **options).select(as_word(F.col("token")).alias("word"), "cnt")


def pair_counts(words: DataFrame) -> DataFrame:
    """l, r, cnt: adjacent pairs over distinct words, weighted by the words' counts."""
    pairs = words.select(F.explode(adjacent_pairs(F.col("word"))).alias("p"), "cnt")
    return pairs.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("cnt").alias("cnt"))


def top_pair(pairs: DataFrame) -> DataFrame:
    """The pair with the largest (cnt, l, r): one row, none for no pairs."""
    return pairs.agg(F.max(F.struct("cnt", "l", "r")).alias("m")).where("m is not null").select("m.l", "m.r", "m.cnt")


def pair_index(words: DataFrame) -> DataFrame:
    """l, r, word: the words that hold each pair, once each."""
    return words.select("word", F.explode(F.array_distinct(adjacent_pairs(F.col("word")))).alias("p")).select("p.l", "p.r", "word")


def merge_deltas(words: DataFrame, left: str, right: str) -> DataFrame:
    """l, r, delta: how merging one pair changes the pair counts; only words that hold it are touched."""
    held = words.where(F.contains("word", F.lit(f"<{left}><{right}>")))
    old = pair_counts(held).select("l", "r", (-F.col("cnt")).alias("delta"))
    new = pair_counts(held.withColumn("word", merge_pair(F.col("word"), left, right))).select("l", "r", F.col("cnt").alias("delta"))
    return old.unionByName(new).groupBy("l", "r").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def apply_deltas(pairs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Pair counts after a merge; pairs that no longer occur are dropped."""
    both = pairs.unionByName(deltas.select("l", "r", F.col("delta").alias("cnt")))
    return both.groupBy("l", "r").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def totals(words: DataFrame) -> DataFrame:
    """n_unique, n_total of a word-count table; 0 for an empty one."""
    return words.agg(F.count("*").alias("n_unique"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("n_total"))


def index_totals(index: DataFrame) -> DataFrame:
    """n_pairs, n_entries, mean_words (0 without pairs) of a pair index."""
    by = index.groupBy("l", "r").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_entries"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_words"))
