"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of all orders up to ``order`` words, and the uniform one, are mixed.  The
weights depend on the longest context that was seen and on how often (a bucket for each power of two) and
are learned by expectation-maximisation on events of training documents that were held out of the
counts.  Scores then use the counts of all training documents.

Expectation-maximisation sees events in cells: by context bucket, and by each estimate to half a power of
two.  A cell stands at the mean logarithms of its own events, so an estimate is off by a factor of the
root of two at most, and not at all on average.

Scale: documents are dealt into blocks by a hash.  A block sends its distinct n-grams
with its own counts to parts by key range; a part adds them up and answers with corpus
totals in the order asked.  What moves is one packed binary a block and part.  The vocabulary
and the n-gram tables are never on the driver or broadcast; the driver gets cells of events
(at most buckets x 64 to the power of order) and a row of totals a part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import cuts, grouped, pack, unpack
from .scratch import settle, small_batches
from .text import Words, chunks, mix, sums

#: Bytes of text in a block, on average.
BLOCK_BYTES = 12 << 20
#: More rows than this that are equal in doc_id and text are dealt into several blocks.
EQUAL_ROWS = 10_000
END, BEGIN = np.uint64(0x51ED270B7F4E4C11), np.uint64(0x2545F4914F6CDD1D)
BUCKETS, CLASSES = 24, 64
#: The kind of a message: totals, or the order of its n-grams.
TOTALS = 0


class Block:
    """Tokens of a block's documents: the distinct n-grams of each order, and which one ends at each token."""

    def __init__(self, table: pa.Table, order: int):
        hashes, counts = [], []
        for batch in chunks(table.to_batches()):
            w = Words(batch.column("text"), lower=True)
            hashes.append(w.hashes())
            counts.append(w.counts)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        fold = table.column("fold").to_numpy().astype(np.int64)
        self.order = order
        self.first = np.concatenate([[0], np.cumsum(n + 1)])  # with one end a document
        token = np.empty(len(h) + len(n), np.uint64)
        ends = self.first[1:] - 1
        is_word = np.ones(len(token), bool)
        is_word[ends] = False
        token[is_word], token[ends] = h, END
        self.begins = self.first[:-1]
        self.keys, self.which = {}, {}
        gram = token
        for k in range(1, order + 1):
            if k > 1:  # the shorter n-gram that ends a token before, and the token
                before = np.empty_like(gram)
                before[1:] = gram[:-1]
                before[self.begins] = BEGIN
                gram = mix(before * np.uint64(0xD6E8FEB86659FD93) + token, k + 1)
            self.keys[k], self.which[k] = grouped(gram)
        self.fold = np.repeat(fold, n + 1)
        self.doc_fold = fold

    def counts(self, k: int, chosen: np.ndarray) -> np.ndarray:
        return np.bincount(self.which[k][chosen], minlength=len(self.keys[k])).astype(np.uint32)


def kept(fold: np.ndarray) -> np.ndarray:
    return fold > 1


def held(fold: np.ndarray) -> np.ndarray:
    return fold == 1


def ask(parts: int, order: int):
    """What a block sends: its keys and its own counts, in the kept and the held training documents."""

    def run(table: pa.Table) -> pa.Table:
        b = Block(table, order)
        rows = []
        block = table.column("block")[0].as_py()
        for kind, keys in b.keys.items():
            a, c = b.counts(kind, kept(b.fold)), b.counts(kind, held(b.fold))
            at = cuts(keys, parts)
            rows += [(block, p, kind, pack(keys[i:j], True), pack(a[i:j]), pack(c[i:j])) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        rows.append((block, 0, TOTALS, pack(np.array([kept(b.doc_fold).sum(), held(b.doc_fold).sum()], np.uint64)), b"", b""))
        return pa.Table.from_pylist([dict(zip(ASKED.names, r)) for r in rows], ASKED)

    return run


ASKED = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("kept", pa.binary()), ("held", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("kept", pa.binary()), ("train", pa.binary())])


def answer(table: pa.Table) -> pa.Table:
    """Corpus totals for every key asked of a part, and the part's share of the corpus totals."""
    kinds = table.column("kind").to_numpy()
    rows, totals = [], np.zeros(6, np.uint64)
    part = table.column("part")[0].as_py()
    for kind in np.unique(kinds[kinds != TOTALS]).tolist():
        at = np.flatnonzero(kinds == kind)
        keys = [unpack(table.column("keys")[int(i)].as_py()) for i in at]
        sizes = [len(k) for k in keys]
        _, which = grouped(np.concatenate(keys))
        del keys
        n = int(which.max()) + 1
        mine = [np.concatenate([unpack(table.column(c)[int(i)].as_py()) for i in at]) for c in ("kept", "held")]
        keep = np.bincount(which, mine[0], n).astype(np.uint64)
        train = keep + np.bincount(which, mine[1], n).astype(np.uint64)
        if kind == 1:
            totals[:4] = keep.sum(), np.count_nonzero(keep), train.sum(), np.count_nonzero(train)
        low = 0
        for i, size in zip(at, sizes):
            of = which[low : low + size]
            low += size
            wide = np.uint64 if train.max(initial=0) >= 1 << 32 else np.uint32
            rows.append((table.column("block")[int(i)].as_py(), part, kind, pack(keep[of].astype(wide)), pack(train[of].astype(wide))))
    for i in np.flatnonzero(kinds == TOTALS):
        totals[4:] += unpack(table.column("keys")[int(i)].as_py())
    rows.append((-1, part, TOTALS, pack(totals), b""))
    return pa.Table.from_pylist([dict(zip(ANSWER.names, r)) for r in rows], ANSWER)


def gather(b: Block, answers: pa.Table, column: str) -> dict[int, np.ndarray]:
    """Corpus counts of the block's distinct n-grams of each order, in their order."""
    kinds, parts = answers.column("kind").to_numpy(), answers.column("part").to_numpy()
    out = {}
    for kind, keys in b.keys.items():
        at = np.flatnonzero(kinds == kind)
        at = at[np.argsort(parts[at])]
        out[kind] = np.concatenate([unpack(answers.column(column)[int(i)].as_py()) for i in at]).astype(np.float64)
        assert len(out[kind]) == len(keys), "an answer is missing"
    return out


class Estimates:
    """For each token: its count, its context's bucket, and maximum-likelihood estimates from the longest context down."""

    def __init__(self, b: Block, counts: dict[int, np.ndarray], tokens: float, docs: float):
        self.count = counts[1][b.which[1]]
        self.bucket = np.zeros(len(self.count), np.int64)
        self.p = [self.count / max(tokens, 1)]
        for k in range(2, b.order + 1):
            seen = np.empty(len(self.count))  # how often the context was followed by anything
            seen[1:] = counts[k - 1][b.which[k - 1][:-1]]
            seen[b.begins] = docs
            self.p.insert(0, counts[k][b.which[k]] / np.maximum(seen, 1))
            level = np.minimum(np.floor(np.log2(np.maximum(seen, 1))) + 1, BUCKETS - 1) + (k - 2) * BUCKETS
            self.bucket = np.where(seen > 0, level, self.bucket).astype(np.int64)


def histogram(totals: np.ndarray, order: int):
    """Events of the held-out training documents by cell: how many, and the sums of the logarithms of their estimates."""
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64()), *[(f"s{i}", pa.float64()) for i in range(order)]])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        b = Block(docs, order)
        e = Estimates(b, gather(b, answers, "kept"), totals[0], totals[4])
        at = held(b.fold)
        cell, logs = e.bucket[at], []
        for p in e.p:
            p = p[at]
            logs.append(np.where(p > 0, np.log2(np.maximum(p, 1e-300)), 0.0))
            cell = cell * CLASSES + np.where(p > 0, 1 + np.minimum(np.round(-2 * logs[-1]), CLASSES - 2), 0).astype(np.int64)
        cells, which = np.unique(cell, return_inverse=True)
        return pa.table([pa.array(cells), pa.array(np.bincount(which, minlength=len(cells))), *[pa.array(np.bincount(which, x, len(cells))) for x in logs]], schema=schema)

    return run


def learn(cells: np.ndarray, n: np.ndarray, logs: np.ndarray, vocabulary: float, rounds: int = 100) -> np.ndarray:
    """Mixture weights (longest context to none, uniform) of each context bucket, by expectation-maximisation.

    ``logs`` has a row a cell: the mean logarithms of its estimates.
    """
    order = logs.shape[1]
    rest, known = cells.copy(), np.zeros((len(cells), order), bool)
    for i in range(order - 1, -1, -1):
        known[:, i] = rest % CLASSES > 0
        rest = rest // CLASSES
    bucket, buckets = rest, BUCKETS * max(order - 1, 1)
    p = np.concatenate([np.where(known, 2.0**logs, 0), np.full((len(cells), 1), 1 / (vocabulary + 1))], 1)
    # contexts that weren't seen have no weight: bucket 0 has none, those of a level have those up to it
    level = np.where(np.arange(buckets) == 0, 1, np.arange(buckets) // BUCKETS + 2)
    weights = np.where(order - np.arange(order)[None, :] <= level[:, None], 1.0, 0.0)
    weights = np.concatenate([0.9 * weights / weights.sum(1, keepdims=True), np.full((buckets, 1), 0.1)], 1)
    possible = weights > 0
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(1))[:, None]
        total = np.stack([np.bincount(bucket, share[:, k], buckets) for k in range(order + 1)], 1) + weights * 0.5 + 1e-3
        total = np.where(possible, total, 0)
        weights = total / total.sum(1, keepdims=True)
    return weights


def scorer(totals: np.ndarray, weights: np.ndarray):
    tokens, vocabulary, docs = float(totals[2]), float(totals[3]), float(totals[4] + totals[5])
    order = weights.shape[1] - 1

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = scored(table.schema.field("doc_id").type)
        if not table.num_rows:
            return schema.empty_table()
        b = Block(table, order)
        e = Estimates(b, gather(b, answers, "train"), tokens, docs)
        w = weights[e.bucket]
        log = np.log10(sum(w[:, i] * p for i, p in enumerate(e.p)) + w[:, order] / (vocabulary + 1))
        base = np.log10((e.count + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        by = lambda x: np.add.reduceat(x, b.first[:-1])  # noqa: E731  no document is without a token
        return pa.table([table.column("doc_id"), pa.array(b.doc_fold == 0), pa.array(np.diff(b.first)), pa.array(sums((e.count > 0).astype(np.int64), b.first)), pa.array(np.full(table.num_rows, int(tokens))), pa.array(by(base)), pa.array(by(log))], schema=schema)

    return run


def scored(doc_id: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", doc_id), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    ``order`` is the longest n-gram, two or more.  Documents whose crc32(doc_id as text) mod 10 is 0 are held
    out of training.  Of the others, remainder 1 gives the events that the weights are learned on.

    Defined results: null or empty text is one end token; a null doc_id trains; doc_id keeps its type; equal rows get
    equal scores; with nothing to learn from, weights stay near their start and words score as
    unknown; an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    if order < 2:
        raise ValueError("the order is two or more")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    equal = docs.groupBy(F.xxhash64("doc_id", text).alias("h")).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes"))
    size, most = equal.agg(F.sum("bytes"), F.max("n")).first()
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES))
    fold = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(10)), F.lit(2))
    many = (most or 0) > EQUAL_ROWS
    salt = [F.floor(F.monotonically_increasing_id() / EQUAL_ROWS)] if many else []
    block = F.pmod(F.xxhash64("doc_id", text, *salt), F.lit(blocks))
    dealt = docs.select("doc_id", fold.cast("int").alias("fold"), block.alias("block"), text.alias("text"))
    if many:  # which row is in which block must not change from pass to pass
        dealt = settle(dealt, "lm-dealt")
    asked = dealt.groupBy("block").applyInArrow(ask(blocks, order), "block long, part int, kind int, keys binary, kept binary, held binary")
    answers = settle(asked.groupBy("part").applyInArrow(answer, "block long, part int, kind int, kept binary, train binary"), "lm-answers")
    totals = np.zeros(6)
    for r in answers.where(f"kind = {TOTALS}").select("kept").collect():
        totals += unpack(bytes(r[0]))
    given = answers.where(f"kind <> {TOTALS}")
    both = lambda f, schema: dealt.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(f, schema)
    names = [f"s{i}" for i in range(order)]
    cells = both(histogram(totals, order), ", ".join(["cell long", "n long", *(f"{c} double" for c in names)]))
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).orderBy("cell").toPandas()
    n = cells["n"].to_numpy(float)
    weights = learn(cells["cell"].to_numpy(np.int64), n, cells[names].to_numpy(float) / np.maximum(n, 1)[:, None], float(totals[1]))
    schema = docs.select("doc_id").schema
    for name, kind in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())):
        schema = schema.add(name, kind)
    return both(scorer(totals, weights), schema)


def lm_query(spark, sf_dir: str) -> DataFrame:
    """op7: base and interpolated log10 probabilities of every document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
