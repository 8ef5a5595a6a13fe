"""Exact n-gram Jaccard join with token-combination prefixes.

Sets are the distinct k-word shingles of whole texts.  Two sets link when their Jaccard similarity
reaches a threshold; the result is each document's component under links.

1. Equal sets are one class (128-bit fingerprints), so copies cost nothing below.
2. Thinning: of half of all shingles, chosen by hash, each set counts those that another set also
   has.  A set that could link must share nearly all of them; most sets share too few and are out.
3. Exact shingle counts over the remaining classes order each set from rare to frequent.  Its
   prefix is as long as it takes for at least one signature to survive the loss of all the shingles
   that a link allows to differ.  Shingles seen once only lengthen the cover.  Rare shingles are
   signatures by themselves.  Frequent ones are dealt into groups by hash and any two of a group make
   a signature: a group of g covers g - 1 losses.  Group counts depend on the set's size class.
4. Sets that share a signature form candidate clusters, and clusters are verified exactly.

Scale: thinning and counts are packed exchanges by key range.  Pairs never become rows.  The driver
holds no documents, links or fingerprints; the one broadcast is a Bloom filter of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .clusters import Forest, verified_links
from .components import components
from .exchange import cuts, grouped, pack, unpack
from .scratch import discard, settle, small_batches
from .text import Words, binary_rows, chunks, mix, shingle_sets, sums

#: Keys held before they are sent, bytes of text for each part of an exchange, sets in a block of step 3.
FLUSH_KEYS, PART_BYTES, BLOCK_SETS = 1_500_000, 16 << 20, 2048
#: Shingles in more sets than this are frequent.
FREQUENT = 32
NO_DOC = 0xFFFF


class Rule:
    """Links are den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        if not 0.6 <= num / den <= 1:
            raise ValueError("the threshold must be between 0.6 and 1")
        self.num, self.den = num, den

    def losses(self, n):
        """How many of n shingles a linked set may lack."""
        return n * (self.den - self.num) // self.den

    def alone(self, n):
        """Whether a set of n shingles can be linked to none but equal sets: it lacks none of another's, and a larger one is too large."""
        return (self.losses(n) == 0) & (n * self.den // self.num == n)

    def linked(self, shared, n, m):
        return self.den * shared >= self.num * (n + m - shared)


def fingerprints(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums(mix(sets, 21), first), sums(mix(sets, 22), first)


ASK = pa.schema([("src", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("doc", pa.binary())])


def ask_shared(k: int, parts: int):
    """Step 2, at the documents: half of the shingles by key range, with the set each is from."""

    def send(src, prints, sizes, keys, doc):
        n = len(prints)
        order = np.argsort(keys)
        keys, doc = keys[order], doc[order]
        again = np.zeros(len(keys), bool)
        if len(keys):
            again[1:] = keys[1:] == keys[:-1]
        multi = again.copy()
        multi[:-1] |= again[1:]
        here = np.bincount(doc[multi], minlength=n).astype(np.uint32)
        total = np.bincount(doc, minlength=n).astype(np.uint32)
        rows = [(src, -1, pack(prints), pack(np.concatenate([sizes.astype(np.uint32), total, here])))]
        doc = np.where(multi, NO_DOC, doc).astype(np.uint16)  # shared already: one entry tells the others
        keys, doc = keys[~again] >> np.uint64(16), doc[~again]
        at = cuts(keys << np.uint64(16), parts)
        rows += [(src, p, pack(keys[i:j], True), pack(doc[i:j])) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        return pa.RecordBatch.from_pylist([dict(zip(ASK.names, r)) for r in rows], ASK)

    def run(batches):
        task, flush = TaskContext.get().partitionId(), 0
        seen, held, count = set(), [], 0
        for b in chunks(batches):
            words = Words(b.column(0), lower=True)
            sets, first = shingle_sets(words, k)
            prints, _ = fingerprints(sets, first)
            size = np.diff(first)
            new = np.array([s >= 0 and p not in seen and not seen.add(p) for p, s in zip(prints.tolist(), size.tolist())], bool) & (size > 0)
            half = (sets & np.uint64(1) == 0) & np.repeat(new, size)
            ids = np.cumsum(new) - 1 + sum(len(h[0]) for h in held)
            held.append((prints[new], size[new], sets[half], np.repeat(ids, size)[half]))
            count += int(half.sum())
            if count >= FLUSH_KEYS or sum(len(h[0]) for h in held) > 30_000:
                yield send((task << 24) + flush, *(np.concatenate(c) for c in zip(*held)))
                seen, held, count, flush = set(), [], 0, flush + 1
        if held:
            yield send((task << 24) + flush, *(np.concatenate(c) for c in zip(*held)))

    return run


def count_shared(table: pa.Table) -> pa.Table:
    """Step 2, at a key range: for each sender's sets, how many of their keys another sender has too."""
    src = table.column("src").to_numpy()
    part = table.column("part")[0].as_py()
    keys = [unpack(x.as_py()) for x in table.column("keys")]
    docs = [unpack(x.as_py()) for x in table.column("doc")]
    if part < 0:  # the sets themselves only pass through
        return table.select(["src", "part", "keys", "doc"])
    values, which = grouped(np.concatenate(keys))
    shared = np.bincount(which, minlength=len(values)) > 1
    rows, low = [], 0
    for s, d in zip(src, docs):
        hit = d[shared[which[low : low + len(d)]]]
        low += len(d)
        counts = np.bincount(hit[hit != NO_DOC].astype(np.int64)).astype(np.uint32)
        rows.append((int(s), part, pack(counts), b""))
    return pa.Table.from_pylist([dict(zip(ASK.names, r)) for r in rows], ASK)


def keep_shared(rule: Rule):
    """Step 2, at the sender's side again: fingerprints of the sets that share enough to go on."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_numpy()
        own = int(np.flatnonzero(parts < 0)[0])
        prints = unpack(table.column("keys")[own].as_py())
        size, total, shared = unpack(table.column("doc")[own].as_py()).astype(np.int64).reshape(3, -1)
        for i in np.flatnonzero(parts >= 0):
            got = unpack(table.column("keys")[int(i)].as_py())
            shared[: len(got)] += got
        allowed = rule.losses(size)
        go = ~rule.alone(size) & (total - shared <= allowed)
        return pa.table({"print": pa.array(prints[go].view(np.int64))})

    return run


def emit_sets(k: int, bits):
    """doc_id, n, f1, f2 of every document; the set itself once a task for those the filter lets pass."""

    def run(batches):
        table, sent = bits.value, set()
        for b in chunks(batches):
            sets, first = shingle_sets(Words(b.column(1), lower=True), k)
            f1, f2 = fingerprints(sets, first)
            size = np.diff(first)
            go = bloom.may_hold(table, f1) & (size > 0)
            for i in np.flatnonzero(go):
                key = (int(f1[i]), int(f2[i]))
                go[i] = key not in sent
                sent.add(key)
            body = binary_rows(sets[np.repeat(go, size)], np.concatenate([[0], np.cumsum(np.where(go, size, 0))]))
            body = pa.array([x if g else None for x, g in zip(body.to_pylist(), go)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), body], ["doc_id", "n", "f1", "f2", "body"])

    return run


class Sets:
    """A block of sets: all shingles, whose they are, and the distinct ones."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("rid")
        self.rid = table.column("rid").to_numpy()
        self.n = table.column("n").to_numpy()
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.tokens = np.frombuffer(b"".join(x.as_py() for x in table.column("body")), np.uint64)
        self.keys, self.which = grouped(self.tokens)


def ask_counts(parts: int):
    def run(table: pa.Table) -> pa.Table:
        s, src = Sets(table), table.column("block")[0].as_py()
        n = np.bincount(s.which, minlength=len(s.keys)).astype(np.uint32)
        at = cuts(s.keys, parts)
        rows = [(src, p, pack(s.keys[i:j], True), pack(n[i:j])) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        return pa.Table.from_pylist([dict(zip(ASK.names, r)) for r in rows], ASK)

    return run


def answer_counts(table: pa.Table) -> pa.Table:
    keys = [unpack(x.as_py()) for x in table.column("keys")]
    mine = np.concatenate([unpack(x.as_py()) for x in table.column("doc")])
    values, which = grouped(np.concatenate(keys))
    total = np.minimum(np.bincount(which, mine, len(values)), 1 << 30).astype(np.uint32)
    rows, low = [], 0
    for s, k in zip(table.column("src").to_numpy(), keys):
        rows.append((int(s), table.column("part")[0].as_py(), pack(total[which[low : low + len(k)]]), b""))
        low += len(k)
    return pa.Table.from_pylist([dict(zip(ASK.names, r)) for r in rows], ASK)


def signatures(tokens: np.ndarray, counts: np.ndarray, rule: Rule, frequent: int = FREQUENT) -> np.ndarray:
    """The signatures of one set, given in how many sets each of its shingles is."""
    n = len(tokens)
    need = rule.losses(n) + 1
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    once, rare = int(np.searchsorted(counts, 2)), int(np.searchsorted(counts, frequent, "right"))
    if once >= need:
        return tokens[:0]
    out = [mix(tokens[once : min(rare, need)], 31)]
    left = need - rare
    if left > 0:
        often = tokens[rare:]
        least = max(1, -(-rule.num * n // rule.den))  # the smallest set that could link
        for level in {n.bit_length(), least.bit_length()}:
            groups = max(1, int((1 << level) * (rule.den - rule.num) / rule.den / 3))
            group = (mix(often, 40 + level) % np.uint64(groups)).astype(np.int64)
            new = np.zeros(len(group), bool)
            new[np.unique(group, return_index=True)[1]] = True
            cover = np.cumsum(~new)
            end = int(np.searchsorted(cover, left)) + 1
            t, g = often[:end], group[:end]
            by = np.argsort(g, kind="stable")
            t, g = t[by], g[by]
            for d in range(1, int(np.bincount(g).max(initial=0))):
                pair = g[d:] == g[:-d]
                out.append(mix(t[:-d][pair] * np.uint64(0xD6E8FEB86659FD93) + t[d:][pair], 50 + level))
    return np.unique(np.concatenate(out))


def sign(rule: Rule):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"sig": pa.array([], pa.int64()), "rid": pa.array([], pa.int64())})
        s = Sets(table)
        by = np.argsort(answers.column("part").to_numpy())
        counts = np.concatenate([unpack(answers.column("keys")[int(i)].as_py()) for i in by])[s.which]
        found = [signatures(s.tokens[i:j], counts[i:j], rule) for i, j in zip(s.first, s.first[1:])]
        sizes = [len(f) for f in found]
        return pa.table({"sig": pa.array(np.concatenate(found).view(np.int64)), "rid": pa.array(np.repeat(s.rid, sizes))})

    return run


def link_sets(rule: Rule):
    """All links among sets that share shingles, by counting along an inverted list."""

    def find(table: pa.Table, sides: np.ndarray, forest: Forest) -> None:
        n = table.column("weight").to_numpy()
        tokens = np.frombuffer(b"".join(x.as_py() for x in table.column("body")), np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        _, which = grouped(tokens)
        shared = np.bincount(which)[which] > 1
        which, owner = which[shared], owner[shared]
        first = np.searchsorted(owner, np.arange(len(n) + 1))
        order = np.argsort(which, kind="stable")
        post, edge = owner[order], np.searchsorted(which[order], np.arange(which.max(initial=-1) + 2))
        two = len(np.unique(sides)) > 1
        for i in range(len(n)):
            if forest.parts == 1:
                return
            w = which[first[i] : first[i + 1]]
            low, size = edge[w], edge[w + 1] - edge[w]
            if not len(w):
                continue
            skip = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            inter = np.bincount(post[np.arange(len(skip)) + skip], minlength=len(n))
            ok = rule.linked(inter, n[i], n) & (forest.label != forest.label[i])
            if two:
                ok &= sides != sides[i]
            for j in np.flatnonzero(ok):
                forest.join(i, int(j))

    return find


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, f1, f2 (fingerprints of the set) for every document.

    Defined results: documents without words (or text) have an empty set, link with nothing and are
    their own component; texts with fewer than k words are one shingle, so they link to equal
    sequences only; equal rows share a component; a null doc_id takes part, but a component's id is
    its smallest id that isn't null (null if there is none); an empty table gives no rows; columns
    other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rule = Rule(num, den)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    ask = "src long, part int, keys binary, doc binary"

    asked = base.select("text").mapInArrow(ask_shared(k, parts), ask)
    # the senders' own rows go along, dealt by sender, so that texts are read once
    route = F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("src"), F.lit(parts))).otherwise(F.col("part"))
    passed = asked.groupBy(route.alias("route")).applyInArrow(count_shared, ask)
    prints = passed.groupBy("src").applyInArrow(keep_shared(rule), "print long")
    bits = spark.sparkContext.broadcast(bloom.build(prints))

    schema = base.select("doc_id").schema.add("n", "long").add("f1", "long").add("f2", "long").add("body", "binary")
    table = settle(base.mapInArrow(emit_sets(k, bits), schema), "sets")
    classes = table.where("body is not null").dropDuplicates(["f1", "f2"])
    sets = settle(classes.select(F.monotonically_increasing_id().alias("rid"), "f1", "f2", "n", "body"), "classes")

    full = settle(table.drop("body"), "set-sizes")
    discard(table)

    blocks = sets.select("rid", "n", "body", F.floor(F.col("rid") / BLOCK_SETS).alias("block"))
    set_parts = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // 2_000_000))
    counted = blocks.groupBy("block").applyInArrow(ask_counts(set_parts), ask).groupBy("part").applyInArrow(answer_counts, ask)
    signed = settle(blocks.groupBy("block").cogroup(counted.groupBy("src")).applyInArrow(sign(rule), "sig long, rid long"), "signatures")
    anchor = signed.groupBy("sig").agg(F.min("rid").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    candidate = components(signed.join(anchor, "sig").where("rid <> a").select("a", F.col("rid").alias("b")).distinct())
    items = sets.join(candidate, F.col("rid") == F.col("id")).select(F.col("root").alias("cluster"), "id", F.col("n").alias("weight"), "body")
    links = settle(verified_links(items, link_sets(rule)), "links")
    discard(signed, candidate)
    found = components(links)

    own = full.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("least"))
    joined = own.join(sets.select("f1", "f2", "rid").join(found, F.col("rid") == F.col("id")).select("f1", "f2", "root"), ["f1", "f2"], "left")
    roots = joined.where("root is not null").groupBy("root").agg(F.min("least").alias("all_least"))
    final = joined.join(roots, "root", "left").select("f1", "f2", F.coalesce("all_least", "least").alias("component_id"))
    final = settle(final, "class-components")
    discard(sets, links, found)
    linked = full.where("n > 0").join(final, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "f1", "f2")
    out = linked.unionAll(full.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "f1", "f2"))
    out._tessella_tables = (full, final)  # noqa: SLF001  what the result still reads
    return out


def jaccard_query(spark, sf_dir: str) -> DataFrame:
    """op3: 3-word shingles, Jaccard similarity of 0.9 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.  Empty documents all stay.

    Rows that share a doc_id within a component, and components without any doc_id, keep one row.
    """
    joined = jaccard_components(docs, k, num, den)
    found = settle(joined, "components")
    discard(*joined._tessella_tables)  # noqa: SLF001
    keep = found.where("n_shingles > 0 and component_id is not null and doc_id = component_id").select("doc_id", "component_id")
    names = docs.columns
    unique = keep.count() == keep.select("component_id").distinct().count()
    no_id = found.where("n_shingles > 0 and component_id is null").limit(1).count()
    empty = F.coalesce(F.length(F.regexp_replace(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0
    rows = docs.where(~empty)
    kept = rows.join(keep.select(F.col("doc_id").alias("keep_id_")).distinct(), F.col("doc_id") == F.col("keep_id_"), "left_semi")
    if not unique:
        kept = kept.dropDuplicates(["doc_id"])
    if no_id:
        kept = kept.unionAll(_one_without_id(rows.where("doc_id is null"), found, k))
    return kept.unionAll(docs.where(empty)).select(*names)


def _one_without_id(rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Documents without an id that link to none with one: equal sets keep one row."""
    names = rows.columns
    schema = rows.select("*").schema.add("f1_", "long").add("f2_", "long")

    def run(batches):
        for b in chunks(batches):
            sets, first = shingle_sets(Words(b.column("text"), lower=True), k)
            f1, f2 = fingerprints(sets, first)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))], schema.fieldNames())

    alone = found.where("n_shingles > 0 and component_id is null").select(F.col("f1").alias("f1_"), F.col("f2").alias("f2_")).distinct()
    return rows.mapInArrow(run, schema).join(alone, ["f1_", "f2_"]).dropDuplicates(["f1_", "f2_"]).select(*names)


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group of near copies stays (five words, similarity 0.8)."""
    return keep_one(docs)
