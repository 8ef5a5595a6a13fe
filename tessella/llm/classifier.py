"""Quality classifier: histogram gradient-boosted trees over document statistics.

The fit runs in numpy on the driver over a bounded sample of labelled rows (those with the
smallest hashes of doc_id).  Trees are complete binary trees kept as flat arrays, so that
scoring a chunk is a few vector operations a tree and level; every whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle, small_batches
from .stats import Stats
from .text import chunks

#: At most so many labelled rows are fitted on: about 4 MB at the driver.
SAMPLE_ROWS = 20_000
FEATURES = ("log_words", "chars_per_word", "symbols", "symbol_ends", "upper", "capitals", "digits", "punctuation", "bangs", "bars", "stops", "repeats", "duplicate_lines", "distinct", "adjacent", "long_words", "short_words", "words_per_line", "wide_bytes")


def features(s: Stats) -> np.ndarray:
    n, c = np.maximum(s.n_words, 1), np.maximum(s.n_chars, 1)
    return np.stack([
        np.log1p(s.n_words), s.word_chars / n, s.n_symbols / n, s.n_symbol_ends / n, s.n_upper / np.maximum(s.n_letters, 1),
        s.n_capital_words / n, s.n_digits / c, s.n_punct / n, s.n_bang / n, s.n_bar / n, s.n_stop_words / n, s.n_repeat_words / n,
        s.n_dup_lines / np.maximum(s.n_lines, 1), s.n_distinct / n, s.n_adjacent / n, s.n_long_words / n, s.n_short_words / n,
        s.n_words / np.maximum(s.n_lines, 1), s.word_bytes / np.maximum(s.word_chars, 1),
    ], 1).astype(np.float64)


@dataclass
class Forest:
    """feature and threshold: (trees, inner nodes); leaf: (trees, leaves); node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        depth = int(np.log2(inner + 1))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 5.0) -> Forest:
    """Boost logistic loss with second-order gains.  Without rows or with one class, the prior alone decides."""
    n = len(y)
    inner = 2**depth - 1
    prior = np.clip((y.sum() + 0.5) / (n + 1), 1e-3, 1 - 1e-3)
    forest = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(prior / (1 - prior))))
    if n == 0 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    total = np.full(n, forest.start)
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            cut = np.zeros(width, np.int64)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - base) * bins + binned[:, j]
                gl = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hl = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
                gain = gain[:, : len(e)]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[base : base + width][better] = j
                cut[better] = at[better]
                threshold[base : base + width][better] = e[at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf_of = node - inner
        gs, hs = np.bincount(leaf_of, g, inner + 1), np.bincount(leaf_of, h, inner + 1)
        leaf = -rate * gs / (hs + smooth)
        total += leaf[leaf_of]
        made.append((feature, threshold, leaf))
    forest.feature, forest.threshold, forest.leaf = (np.stack(c) for c in zip(*made))
    return forest


def fold(column="doc_id", folds: int = 3):
    return F.pmod(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on the labelled rows outside the held-out fold, at most ``sample_rows`` of them.

    A document with several labels counts as the majority says; null labels and null ids are left out.
    """
    small_batches(docs.sparkSession)
    usable = labels.where("quality is not null and doc_id is not null").where(fold() != 1)
    one = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("l_id"), "y")
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("y", "text")

    def run(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(features(Stats(b.column(1)))), pa.list_(pa.float64()))], ["y", "x"])

    rows = chosen.mapInArrow(run, "y int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["y"].to_numpy()))  # the order rows arrive in must not matter
    return fit(x[order], rows["y"].to_numpy(float)[order])


def score(docs: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; documents without words score by their statistics, all zero."""
    small_batches(docs.sparkSession)
    schema = docs.select("*").schema.add(name, "double")
    names = schema.fieldNames()

    def run(batches):
        for b in chunks(batches):
            x = features(Stats(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(x))], names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Defined results: null text is an empty text; equal texts get equal scores; a null doc_id is
    not held out; without labels the score is 0.5; an empty table gives no rows; columns other
    than doc_id and text are ignored.
    """
    forest = train(docs, labels, sample_rows)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), forest)
    held = F.coalesce(fold() == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classifier_query(spark, sf_dir: str) -> DataFrame:
    """op4: held_out, score and predicted of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def classifier_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: drop the documents that the classifier rejects.  Scores run beside the row, so no join is needed."""
    names = docs.columns
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, forest, "forest_score_").where("forest_score_ >= 0.5").select(*names)
