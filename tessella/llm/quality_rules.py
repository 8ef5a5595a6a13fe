"""Quality rules as weak supervision: rules vote good, vote bad or abstain.

A document's votes form a pattern.  Expectation-maximisation over the counts of the
patterns estimates, without labels, how often each rule's vote is right on good and on bad
documents, and the share of good documents; a document is kept when the posterior
probability of good is at least ``threshold``.  This replaces filters that ask all rules to
pass: a single bad vote of a rule that is often wrong is outvoted, and rules that vote good
on nearly everything weigh next to nothing.

Scale: one pass over the texts makes a small table; the driver gets one row a
pattern (at most 3 to the number of rules), never a row a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle, small_batches
from .stats import Stats
from .text import chunks

#: name, statistic, bad beyond, good up to: a rule abstains between the two.  The limits are those of common heuristic
#: filters of web text, not fitted to labels; good is what stays well within them.
RULES = (
    ("symbols", lambda s, n: s.n_symbols / n, 0.10, 0.01),
    ("symbol_ends", lambda s, n: s.n_symbol_ends / n, 0.10, 0.01),
    ("upper", lambda s, n: s.n_upper / np.maximum(s.n_letters, 1), 0.30, 0.10),
    ("bangs", lambda s, n: s.n_bang / n, 0.20, 0.02),
    ("repeats", lambda s, n: s.n_repeat_words / n, 0.30, 0.05),
    ("adjacent", lambda s, n: s.n_adjacent / n, 0.15, 0.03),
    ("duplicate_lines", lambda s, n: s.n_dup_lines / np.maximum(s.n_lines, 1), 0.30, 0.05),
    ("long_words", lambda s, n: s.n_long_words / n, 0.20, 0.02),
    ("few_distinct", lambda s, n: 1 - s.n_distinct / n / np.minimum(1, 8 / np.log2(n + 2)), 0.70, 0.40),
    ("marks", lambda s, n: 1 - (s.n_letters + s.word_bytes - s.word_chars) / np.maximum(s.word_chars, 1), 0.20, 0.06),
    ("word_length", lambda s, n: np.abs(s.word_chars / n - 6.5), 3.5, 2.5),
    ("few_sentences", lambda s, n: 1 - s.n_stop_words / n, 0.98, 0.96),
    ("few_short_words", lambda s, n: 1 - s.n_short_words / n, 0.90, 0.80),
)
#: Where estimation starts: rules seldom vote bad on good documents, and each catches only some of the bad ones.  Votes
#: of ten documents stand for it, so that a rule which hardly votes stays near.
START_GOOD, START_BAD, START_VOTES = 0.99, 0.3, 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def votes(s: Stats) -> np.ndarray:
    """One row a document, one column a rule: 1 good, 2 bad, 0 abstains.  Without words all abstain."""
    n = np.maximum(s.n_words, 1)
    out = np.zeros((len(n), len(RULES)), np.int8)
    for j, (_, f, bad, good) in enumerate(RULES):
        x = f(s, n)
        out[:, j] = np.where(s.n_words == 0, 0, np.where(x > bad, 2, np.where(False if good is None else x <= good, 1, 0)))
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the vote pattern (a number in base 3, first rule lowest)."""
    small_batches(docs.sparkSession)
    schema = docs.select("doc_id").schema
    for c in (*COUNTS, "pattern"):
        schema = schema.add(c, "long")
    powers = 3 ** np.arange(len(RULES))

    def run(batches):
        for b in chunks(batches):
            s = Stats(b.column(1))
            own = [pa.array(np.asarray(getattr(s, c), np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([b.column(0), *own, pa.array(votes(s) @ powers, pa.int64())], ["doc_id", *COUNTS, "pattern"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, each rule's accuracy (share of right votes), and the share of good documents.

    ``patterns`` is (m, rules) of 0, 1, 2.  A rule that votes has one probability of being right on good documents
    and one on bad ones; a rule that abstains says nothing.  The start fixes which class is which, and a vote for a class is
    never taken as evidence against it.
    """
    good, bad = patterns == 1, patterns == 2
    voted = good | bad
    on_good, on_bad, prior = np.full(patterns.shape[1], START_GOOD), np.full(patterns.shape[1], START_BAD), 0.8
    post = np.full(len(patterns), prior)
    for _ in range(rounds):
        score = good @ np.log(on_good / (1 - on_bad)) + bad @ np.log((1 - on_good) / on_bad) + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        done = np.max(np.abs(new - post), initial=0) < 1e-9
        post = new
        if done:
            break
        is_good, is_bad = counts * post, counts * (1 - post)
        on_good = np.clip((is_good @ good + START_VOTES * START_GOOD) / (is_good @ voted + START_VOTES), 0.5, 0.999)
        on_bad = np.clip((is_bad @ bad + START_VOTES * START_BAD) / (is_bad @ voted + START_VOTES), 1.001 - on_good, 0.999)
        prior = float(np.clip((counts @ post + 4) / (counts.sum() + 5), 1e-6, 1 - 1e-6))
    accuracy = ((counts * post) @ good + (counts * (1 - post)) @ bad) / np.maximum(counts @ voted, 1)
    return post, accuracy, prior


def quality_votes(docs: DataFrame, threshold: float = 0.5, min_words: int = 50, repeat_share: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, posterior, kept.

    Defined results: null or empty text has zero counts, fails the base and isn't kept; patterns
    where all rules abstain get the prior; equal rows get equal results; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    table = settle(measure(docs), "votes")
    found = table.groupBy("pattern").count().collect()
    codes = np.array([r["pattern"] for r in found], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(RULES)) % 3).reshape(len(codes), len(RULES))
    post, _, _ = estimate(patterns, np.array([r["count"] for r in found], float))
    # a row a pattern that occurs, at most 3 ** len(RULES) = 1,594,323
    known = F.broadcast(spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post)], "v_pattern long, posterior double"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * repeat_share)
    out = table.join(known, F.col("pattern") == F.col("v_pattern"), "left").withColumn("base_failed", failed)
    return out.select("doc_id", *COUNTS, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"))


def rules_query(spark, sf_dir: str) -> DataFrame:
    """op5: base counts, base verdict and the posterior's verdict for every document."""
    return quality_votes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
