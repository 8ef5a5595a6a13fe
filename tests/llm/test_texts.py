"""Decontamination, Jaccard join, line dedup, sanitisation, preferences: against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import decontaminate, jaccard, lines, preference, sanitise
from tessella.llm.components import components
from tests.conftest import rows_of
from tests.llm import edge


def union(items, links):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def shingles(text, k):
    w = edge.words(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_jaccard(rows, k, num, den):
    sets, index, links = {i: shingles(t, k) for i, t in rows}, defaultdict(list), []
    for i, s in sets.items():
        shared = Counter(o for x in s for o in index[x])
        links += [(i, o) for o, n in shared.items() if den * n >= num * (len(s) + len(sets[o]) - n)]
        for x in s:
            index[x].append(i)
    root = union(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def varied(n, seed):
    """Groups of near copies at all distances around the threshold, beside texts of frequent words only."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(12):
        base = [f"g{g}w{rng.integers(40 if g % 3 else 4000)}" for _ in range(int(rng.integers(3, 160)))]
        for _ in range(n):
            w = list(base)
            for _ in range(int(rng.integers(0, 1 + len(w) // 20))):
                w[rng.integers(len(w))] = f"v{rng.integers(1000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "num", "frequent"), [(3, 90, 32), (5, 80, 4), (2, 95, 1), (3, 90, 1)])
def test_jaccard_components(spark, monkeypatch, k, num, frequent):
    rows = varied(40, k + num)
    real = jaccard.signatures
    monkeypatch.setattr(jaccard, "signatures", lambda t, c, r: real(t, c, r, frequent))
    monkeypatch.setattr(jaccard, "FLUSH_KEYS", 2000)
    got = jaccard.jaccard_components(edge.docs(spark, [(i, t, "s") for i, t in rows]), k, num).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_jaccard(rows, k, num, 100)


def test_jaccard_in_chunks(spark, monkeypatch):
    from tessella.llm import clusters

    rows = varied(40, 5)
    monkeypatch.setattr(clusters.verified_links, "__defaults__", (400,))  # every cluster is cut
    got = jaccard.jaccard_components(edge.docs(spark, [(i, t, "s") for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_jaccard(rows, 3, 90, 100)


def test_jaccard_on_documents(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_query(spark, small).collect()}
    assert got == brute_jaccard(rows, 3, 90, 100)


@pytest.mark.parametrize(("k", "num", "words"), [(3, 90, 11), (5, 80, 8)])
def test_jaccard_of_a_set_inside_another(spark, k, num, words):
    rows = []
    for g in range(40):
        w = [f"g{g}w{i}" for i in range(words)]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join([*w, "more"]))]
    got = jaccard.jaccard_components(edge.docs(spark, [(i, t, "s") for i, t in rows]), k, num).collect()
    want = brute_jaccard(rows, k, num, 100)
    assert want[1] == (words - k + 2, 0)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_awkward_rows(spark):
    got = jaccard.jaccard_components(edge.docs(spark)).collect()
    assert len(got) == len(edge.ROWS)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert by[2][0][1] == 1 and by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[5] == [(0, 5)]
    assert by[6] == [(1, 6)] and by[7] == [(1, 6)] and by[None][0][1] is None
    kept = Counter(r["doc_id"] for r in jaccard.keep_one(edge.docs(spark)).collect())
    assert kept == Counter([1, 3, 4, 5, 6, 8, None, 9, 10, 11, 12])
    empty = edge.docs(spark, []).limit(0)
    assert jaccard.jaccard_components(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=3), st.integers(0, 2**32), st.sampled_from([(90, 100), (80, 100), (2, 3)]), st.integers(1, 6))
def test_linked_sets_share_a_signature(base, seed, rule, frequent):
    rng = np.random.default_rng(seed)
    other = set(base)
    for _ in range(rng.integers(0, 4)):
        other.discard(int(rng.choice(sorted(other or {0}))))
        other.add(int(rng.integers(100, 110)))
    r = jaccard.Rule(*rule)
    if not other or not r.linked(len(base & other), len(base), len(other)) or base == other:
        return
    extra = rng.integers(0, 9, 200)  # how many other sets each token is in
    sign = lambda s: {*jaccard.signatures(np.array(sorted(s), np.uint64), np.array([extra[t] + (t in base) + (t in other) for t in sorted(s)]), r, frequent).tolist()}
    assert sign(base) & sign(other)


@pytest.mark.parametrize("task_edges", [None, 40])
def test_components(spark, task_edges):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(500, 600)] + [(700, i) for i in range(701, 900)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), task_edges=task_edges).collect()}
    want = union({v for e in links for v in e}, links)
    assert got == {v: r for v, r in want.items() if any(v in e and e[0] != e[1] for e in links)}
    assert components(spark.createDataFrame([], "a long, b long"), task_edges=task_edges).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12), st.integers(0, 12))
def test_edit_distance(a, b, most):
    got, want = lines.edit_distance(a, b, most), levenshtein(a, b)
    assert got == want if want <= most else got > most


def brute_lines(rows):
    table = {c: " " for c in range(128) if not chr(c).isalnum() and c != 10} | {c: c + 32 for c in range(65, 91)} | dict.fromkeys(range(48, 58), 48)
    places, sims = defaultdict(set), {}
    found = lines.Lines(pa.array([t for _, t in rows], pa.string()))
    for doc, number, sim in zip(found.doc, found.number, found.simhash()):
        sims[rows[doc], int(number)] = sim
    for row in rows:
        for number, line in enumerate((row[1] or "").translate(table).split("\n")):
            w = tuple(x for x in line.split(" ") if x)
            if len(w) >= lines.MIN_WORDS:
                places[w].add((row[0], number))
                sims[w] = sims[row, number]
    keys = list(places)
    links = [(i, j) for i in range(len(keys)) for j in range(i) if bin(int(sims[keys[i]]) ^ int(sims[keys[j]])).count("1") <= lines.DISTANCE and 100 * levenshtein(keys[i], keys[j]) <= 20 * max(len(keys[i]), len(keys[j]))]
    root, groups = union(range(len(keys)), links), defaultdict(set)
    for i, w in enumerate(keys):
        groups[root[i]] |= places[w]
    lost = defaultdict(set)
    for g in groups.values():
        for d, number in g - {min(g)}:
            lost[d].add(number)
    return lost, len(links)


def test_lines_against_brute_force(spark, monkeypatch):
    rng, rows = np.random.default_rng(8), []
    bases = [[f"b{g}x{rng.integers(50)}" for _ in range(int(rng.integers(5, 60)))] for g in range(25)]
    for d in range(60):
        text = []
        for _ in range(int(rng.integers(0, 6))):
            w = list(bases[rng.integers(len(bases))])
            for _ in range(int(rng.integers(0, 3))):
                w[rng.integers(len(w))] = f"n{rng.integers(9)}"
            text.append(" ".join(w).upper() if rng.random() < 0.2 else ", ".join(w))
        rows.append((d, "\n".join(text)))
    monkeypatch.setattr(lines, "PART_KEYS", 50)
    lost, links = brute_lines(rows)
    assert links > 5
    got = {r["doc_id"]: set(r["dropped"]) for r in lines.duplicate_lines(edge.docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == dict(lost)
    left = {r["doc_id"]: r for r in lines.dedup_lines(edge.docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    for i, t in rows:
        want = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in lost[i])
        assert left[i]["text"] == want and left[i]["n_chars"] == len(want)


def fresh_word(rng):
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8))


def edited(rng, w, edits):
    """So many edits of different words: replaced, left out, or a word put in."""
    w = list(w)
    for at in sorted(rng.choice(len(w), edits, replace=False).tolist(), reverse=True):
        kind = rng.integers(4)
        w[at : at + 1] = [[fresh_word(rng)], [], [w[at], fresh_word(rng)], [fresh_word(rng)]][kind]
    return w


@pytest.mark.parametrize("one_piece", [True, False])
def test_recall_of_fuzzy_lines(spark, monkeypatch, one_piece):
    """By edit similarity alone: lines of 6 to 12 words lose hardly any pair, longer ones at the threshold itself few."""
    if not one_piece:
        monkeypatch.setattr(lines, "PART_KEYS", 3)
    rng, rows, groups = np.random.default_rng(12), [], {}
    frequent = [fresh_word(rng) for _ in range(40)]
    for n in (6, 8, 10, 12, 16, 20, 40, 80):
        for _ in range(60):
            for name, edits in (("one", 1), ("most", max(1, n // 5))):
                base = [fresh_word(rng) if rng.random() < 0.6 else frequent[rng.integers(40)] for _ in range(n)]
                other = edited(rng, base, edits)
                if 100 * levenshtein(base, other) <= 20 * max(n, len(other)):
                    rows += [(len(rows), " ".join(base), "s"), (len(rows) + 1, " ".join(other), "s")]
                    groups.setdefault((n, name), []).append(len(rows) - 1)
    lost = {r["doc_id"] for r in lines.duplicate_lines(edge.docs(spark, rows)).collect()}
    recall = {k: sum(i in lost for i in ids) / len(ids) for k, ids in groups.items()}
    assert all(r >= 0.98 for (n, name), r in recall.items() if n <= 12), recall
    assert all(r >= (0.98 if name == "one" else 0.9) for (n, name), r in recall.items()), recall


def shared_keys(texts, levels, light):
    """For each two texts in a row, whether their lines have the keys in common, at places that may stand for each other, that
    candidates need: two, or one without a place."""
    x = lines.Lines(pa.array(texts, pa.string()))
    keys, first = x.keys(levels, light)
    low = (1 << 2 * lines.SPOT_BITS) - 1
    out = []
    for i in range(0, len(texts), 2):
        a, b = ([(k >> 2 * lines.SPOT_BITS, k & low) for k in keys[first[j] : first[j + 1]].tolist()] for j in (i, i + 1))
        common = {k: lines.NO_SPOT in (p, q) for k, p in a for m, q in b if k == m and lines.in_reach(np.array([p]), np.array([q]))[0]}
        out.append(len(common) > 1 or any(common.values()))
    return out


@pytest.mark.parametrize("kind", ["no counts", "rare and frequent", "frequent only"])
def test_any_two_similar_lines_share_a_key(kind):
    rng, texts = np.random.default_rng(21), []
    frequent = [fresh_word(rng) for _ in range(30)]
    for n in (5, 6, 9, 10, 14, 15, 20, 33, 57, 80, 200):
        for _ in range(150):
            rare = {"no counts": 0.5, "rare and frequent": 0.15, "frequent only": 0.0}[kind]
            base = [fresh_word(rng) if rng.random() < rare else frequent[rng.integers(30)] for _ in range(n)]
            other = edited(rng, base, n // 5)
            if rng.random() < 0.3:  # edits by frequent words, some of them the line's own
                other = list(base)
                for at in rng.choice(n, n // 5, replace=False):
                    other[at] = frequent[rng.integers(30)]
            if len(other) >= lines.MIN_WORDS and 100 * levenshtein(base, other) <= 20 * max(n, len(other)):
                texts += [" ".join(base), " ".join(other)]
    levels = np.zeros(lines.COUNTERS, np.uint8)
    if kind != "no counts":
        words = lines.Lines(pa.array([" ".join(frequent)])).words
        levels[words >> np.uint64(44)] = 100 + rng.integers(0, 50, len(words))
    assert len(texts) > 1500 and all(shared_keys(texts, levels, 50))


def test_long_lines_lose_no_candidate(spark, monkeypatch):
    """Lines that keep only a few words in a row: every word is looked at, so none is missed but by the SimHash."""
    monkeypatch.setattr(lines, "ORDER_SHARE", 1)
    monkeypatch.setattr(lines, "LIGHT", 4)
    rng, rows = np.random.default_rng(22), []
    frequent = [fresh_word(rng) for _ in range(40)]
    for n in (20, 40, 80):
        for i in range(120):
            base = [fresh_word(rng) if rng.random() < (0.6, 0.2)[i % 2] else frequent[rng.integers(40)] for _ in range(n)]
            other = list(base)
            for at in range(int(rng.integers(5)), n, 5):
                other[at] = fresh_word(rng)
            rows += [(len(rows), " ".join(base), "s"), (len(rows) + 1, " ".join(other), "s")]
    lost, links = brute_near(rows)
    assert len(links) > 250
    got = {r["doc_id"] for r in lines.duplicate_lines(edge.docs(spark, rows)).collect()}
    assert got == lost


def test_long_runs_ask_for_places_and_two_keys():
    """Of SimHashes of one key, those at places out of reach don't meet, and a pair is sure only if a second key has it."""
    from tessella.llm.exchange import pack

    rng = np.random.default_rng(23)
    n = lines.SHORT_RUN + 100
    sims = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    sims[1], sims[3] = sims[0] ^ np.uint64(1), sims[2] ^ np.uint64(1)
    spots = np.full(n, (5 << lines.SPOT_BITS) | 10, np.uint64)
    spots[:2] = 10, (9 << lines.SPOT_BITS) | 10
    order = np.argsort(spots, kind="stable")
    found = lines.close_sims(pa.table({"keys": pa.array([pack(spots[order], True)], pa.binary()), "sims": pa.array([sims[order].tobytes()], pa.binary())}))
    of = dict(zip(sims[:, 0].view(np.int64).tolist(), range(n)))
    rows = found.select(["cluster", "sim", "sure"]).to_pylist()
    met = {of[v] for r in rows for v in (r["cluster"], r["sim"]) if v in of}  # some others are close by chance
    assert met >= {2, 3} and not met & {0, 1}
    assert not any(r["sure"] for r in rows)


def counted(monkeypatch, name, size):
    """How much a function of numpy is asked for from now on."""
    total, f = [0], getattr(np, name)

    def run(x, *args, **kwargs):
        total[0] += size(x)
        return f(x, *args, **kwargs)

    monkeypatch.setattr(np, name, run)
    return total


def test_long_runs_compare_what_is_in_reach(monkeypatch):
    """All close pairs of several runs, without a look at each pair of a run."""
    rng, n = np.random.default_rng(25), 3000
    run = np.sort(rng.integers(0, 3, n))
    sims = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    for i in rng.choice(n - 1, 800, replace=False).tolist():
        sims[i + 1] = sims[i] ^ (np.uint64(1) << rng.integers(0, 64, 2, dtype=np.uint64))
    size = rng.integers(6, 300, n)
    spots = (np.minimum(size - 1, rng.integers(0, 300, n)) << lines.SPOT_BITS) | size
    near = rng.random(n) < 0.5
    spots[1:][near[1:]] = spots[:-1][near[1:]]
    spots[rng.choice(n, 20, replace=False)] = lines.NO_SPOT
    i, j = np.triu_indices(n, 1)
    go = (run[i] == run[j]) & lines.near(sims[i, 0], sims[i, 1], sims[j, 0], sims[j, 1]) & lines.in_reach(spots[i], spots[j])
    want = set(zip(i[go].tolist(), j[go].tolist()))
    looked = counted(monkeypatch, "bitwise_count", np.size)
    found = [(min(x), max(x)) for a, b in lines.long_run(sims[:, 0], sims[:, 1], spots, run=run) for x in zip(a.tolist(), b.tolist())]
    assert len(want) > 150 and set(found) == want and len(found) == len(want)
    assert looked[0] < 0.2 * sum(m * m / 2 for m in np.bincount(run).tolist())


def test_unlike_lines_of_a_cluster_are_told_at_once(monkeypatch):
    """Lines of near SimHashes that share too few words aren't compared pair by pair; those that are similar link."""
    rng, n = np.random.default_rng(26), 300
    words = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    bodies = [rng.choice(words, 20, replace=False) for _ in range(n)]
    for i in range(0, 60, 2):
        bodies[i + 1] = np.concatenate([bodies[i][:5], bodies[i][6:], bodies[i][:1]])
    table = pa.table({"id": pa.array(range(n), pa.int64()), "sim": pa.array([7] * n, pa.int64()), "weight": pa.array([20] * n, pa.int64()), "body": pa.array([x.tobytes() for x in bodies], pa.binary())})
    want = {(i, j) for i in range(n) for j in range(i) if 100 * levenshtein(bodies[i].tolist(), bodies[j].tolist()) <= 20 * 20}
    asked = counted(monkeypatch, "count_nonzero", lambda _: 1)
    a, b = lines.link_lines(table, [0, n], np.zeros(n, np.int64))
    assert {(max(x), min(x)) for x in zip(a, b)} == want and len(want) == 30
    assert asked[0] < n * n / 20


@pytest.mark.parametrize("share", [0.02, 0.2, 0.9])
def test_stars_cover_all_pairs(share):
    rng, n = np.random.default_rng(24), 80
    sims = np.sort(rng.choice(1 << 40, n, replace=False)).astype(np.uint64)
    i, j = np.triu_indices(n, 1)
    go = rng.random(len(i)) < share
    rows = lines.stars(sims, j[go], i[go], np.ones(n, bool)).to_pylist()
    sure, other = defaultdict(set), set()
    for r in rows:
        if r["sure"]:
            sure[r["cluster"]] |= {r["cluster"], r["sim"]}
        else:
            other.add((r["cluster"], r["sim"]))
    for a, b in zip(sims[i[go]].tolist(), sims[j[go]].tolist()):
        assert (a, b) in other or any({a, b} <= s for s in sure.values())


@pytest.mark.parametrize("kind", ["random", "two sides", "copies"])
def test_stars_have_rows_in_proportion(kind):
    """Pairs of a group grow with the square of its size, rows of stars with the size; and all pairs are covered."""
    rng, made = np.random.default_rng(25), []
    for n in (300, 1500):
        sims = np.sort(rng.choice(1 << 40, n, replace=False)).astype(np.uint64)
        i, j = np.triu_indices(n, 1)
        go = {"random": rng.random(len(i)) < 0.1, "two sides": (i < n // 2) & (j >= n // 2), "copies": i >= 0}[kind]
        found = lines.Stars(sims, np.ones(n, bool))
        for part in np.array_split(np.flatnonzero(go), 3):
            found.add(i[part], j[part])
        rows = found.rows().to_pylist()
        made.append(len(rows))
        root = {r["sim"]: r["cluster"] for r in rows if r["sure"]}
        other = {(r["cluster"], r["sim"]) for r in rows if not r["sure"]}
        assert not set(root) & set(root.values())
        assert all(root.get(a, a) == root.get(b, b) or (a, b) in other for a, b in zip(sims[i[go]].tolist(), sims[j[go]].tolist()))
    assert made[0] <= 2 * 300 and made[1] <= 8 * made[0]


def brute_near(rows):
    """Which of rows of one line each are lost, and the links: both SimHashes close, and edit similarity."""
    x = lines.Lines(pa.array([t for _, t, _ in rows], pa.string()))
    a, b, split = x.simhash(9), x.simhash(10), [t.split() for _, t, _ in rows]
    links = []
    for i in range(len(rows)):
        for j in np.flatnonzero(lines.near(a[:i], b[:i], a[i], b[i])).tolist():
            if 100 * levenshtein(split[i], split[j]) <= 20 * max(len(split[i]), len(split[j])):
                links.append((i, j))
    root = union(range(len(rows)), links)
    groups = defaultdict(set)
    for i in range(len(rows)):
        groups[root[i]].add(rows[i][0])
    return {i for g in groups.values() for i in g - {min(g)}}, links


def test_unlike_lines_stay(spark):
    rng = np.random.default_rng(3)
    words = [fresh_word(rng) for _ in range(300)]
    rows = [(i, " ".join(words[j] for j in rng.integers(0, 300, int(rng.integers(5, 40)))), "s") for i in range(400)]
    near = [(400 + i, " ".join(edited(rng, rows[i][1].split(), int(0.35 * len(rows[i][1].split())) + 1)), "s") for i in range(50)]
    both = rows + near
    lost = {r["doc_id"] for r in lines.duplicate_lines(edge.docs(spark, both)).collect()}
    split = {i: t.split() for i, t, _ in both}
    alike = {i for i, w in split.items() for j, v in split.items() if j < i and 100 * levenshtein(w, v) <= 20 * max(len(w), len(v))}
    assert lost <= alike


def test_long_documents_of_many_repeated_lines(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        text = "\n".join(f"this is line number {chr(97 + i % 26)} of a text that repeats its few lines" for i in range(n))
        began = time.perf_counter()
        left = lines.dedup_lines(edge.docs(spark, [(0, text, "s")])).collect()
        took.append(time.perf_counter() - began)
        assert left[0]["text"].count("\n") <= 25
    assert took[1] < 4 * took[0] + 10


def test_lines_awkward_rows(spark):
    got = defaultdict(list)
    for r in lines.dedup_lines(edge.docs(spark)).collect():
        got[r["doc_id"]].append(r["text"])
    assert got[1] == [edge.LINE + "\nother words stand here for a change today"]
    assert got[2] == ["", ""] and got[3] == [None] and got[8] == ["two words"] and len(got[None]) == 2
    kept = Counter(r["doc_id"] for r in lines.dedup_lines(edge.docs(spark), keep_emptied=False).collect())
    assert kept == Counter(r[0] for r in edge.ROWS) - Counter({2: 2})
    assert lines.dedup_lines(edge.docs(spark, []).limit(0)).count() == 0


def test_short_lines_are_repeated_by_equal_ones(spark):
    long = "a line of more than five words stands here"
    rows = [(0, f"Home\n{long}\nShare this!\n--\nAll rights reserved"), (1, "HOME\nshare this\n--\nall rights\nbut this line is not like any other line"), (2, "All rights reserved.\nhome page"), (3, "home")]
    got = {r["doc_id"]: r["dropped"] for r in lines.duplicate_lines(edge.docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == {1: [0, 1], 2: [0], 3: [0]}


def test_every_ordinary_word_is_told_from_names(spark):
    """However many words the benchmark has: the rarest of them are no names either."""
    rng = np.random.default_rng(31)
    words = sorted({fresh_word(rng) for _ in range(6000)})
    items = spark.createDataFrame([(i, " ".join(words[i : i + 100] * 2)) for i in range(0, len(words), 100)] + [(7, "zyzzyva is the last word")], "item_id long, text string")
    texts = spark.createDataFrame([(w.capitalize(),) for w in [*words, "Zyzzyva", "Qqqqqqqq"]], "text string")
    got = {r[0]: r[1] for r in texts.withColumn("ordinary", decontaminate.ordinary_words(items)).select("text", decontaminate.template(F.col("text"), F.col("ordinary"))).collect()}
    assert [t for t, kinds in got.items() if kinds == [decontaminate.NAME]] == ["Qqqqqqqq"]
    assert all(kinds == [t.lower()] for t, kinds in got.items() if t != "Qqqqqqqq")


ITEMS = [
    (0, "The train from Paris to Berlin covers 300 km in 4 hours and then another 300 km in 5 hours, so what is its average speed overall"),
    (1, "every word of this item is plain and it says nothing about any number at all, only words follow words until the end"),
    (2, "far too short"), (4, "1 2 3 4 5 6 7 8 9 10 11 12 and 13"), (3, None), (None, "no id at all but many words in this one item here"),
]
QUESTIONS = [
    (1, "intro text. " + ITEMS[0][1] + ". outro", {0: True}),
    (2, "The train from Rome to Madrid covers 120 miles in 7 hours and then another 120 miles in 9 hours, so what is its average speed overall", {0: False}),
    (3, "The train from Rome to Madrid covers 120 miles in 7 hours and then another 130 miles in 9 hours, so what is its average speed overall", {}),
    (4, "EVERY!! WORD!! OF!! THIS!! ITEM!! IS!! PLAIN!! AND!! IT!! SAYS!! NOTHING!! ABOUT!! ANY!! NUMBER!! AT!! ALL!! only words follow", {1: True}),
    (5, "every word of this item is fine and it says quite a lot about some number at most, other words follow", {}),
    (10, "numbers 5 8 1 3 9 12 44 2 71 6 80 91 and 15", {}), (6, "Far too short!", {2: True}), (7, "this is far too short for that", {}), (8, None, {}), (9, "", {}),
    (None, "no id here: " + ITEMS[1][1], {1: True}),
]


def test_decontamination(spark):
    docs, items = edge.docs(spark, [(i, t, "s") for i, t, _ in QUESTIONS] * 2), edge.benchmark(spark, [*ITEMS, ITEMS[0]])
    got = Counter((r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.leaking_documents(docs, items).collect())
    assert got == Counter({(i, item, exact): 2 for i, _, leaks in QUESTIONS for item, exact in leaks.items()})
    left = Counter(r["doc_id"] for r in decontaminate.remove_leaks(docs, items).collect())
    assert left == Counter({i: 2 for i, _, leaks in QUESTIONS if not leaks})


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    docs, items = edge.docs(spark, [(i, t, "s") for i, t, _ in QUESTIONS]), edge.benchmark(spark, ITEMS)
    want = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaking_documents(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaking_documents(docs, items).collect()} == want


def test_leaks_against_brute_force(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    whole = {(d["doc_id"], i["item_id"]) for d in docs for i in items if plain(i["text"]) in plain(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate_query(spark, small).collect()}
    assert got == whole


def test_a_copy_after_an_inner_capital_leaks(spark):
    item = "we saw that Anna met with Bruno before noon and later that Anna read a book while Bruno and Anna ate some bread with Bruno at home"
    docs = edge.docs(spark, [(0, "on the YouTube and McDonald pages they say: " + item, "s"), (1, item, "s")])
    got = {(r["doc_id"], r["exact"]) for r in decontaminate.leaking_documents(docs, edge.benchmark(spark, [(0, item)])).collect()}
    assert got == {(0, True), (1, True)}


def test_decontamination_across_diagonals(spark):
    plain = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    slotted = "a baker named Tom sold some bread to every guest of that inn before a rider came and took what Tom had left on his old table for him and Tom went home"
    short, long = " ".join(plain[:24]), " ".join(plain)
    texts = [
        (0, [*plain[:12], "put", *plain[12:24]], {0}), (1, [*plain[:11], *plain[12:24]], {0}), (2, [*plain[:20], "put", *plain[20:40], "in", *plain[40:]], {0, 1}),
        (3, [slotted.replace("Tom", "Mary Ann")], {2}), (4, [slotted], {2}), (5, plain[:8], set()),
        (6, [*plain[:20], *["far"] * 80, *plain[20:40], *["far"] * 80, *plain[40:]], {0}),
        (7, [slotted.replace("Tom", "Mary", 1).replace("what Tom", "what Lucy")], set()),
    ]
    docs = edge.docs(spark, [(i, " ".join(t), "s") for i, t, _ in texts])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaking_documents(docs, edge.benchmark(spark, [(0, short), (1, long), (2, slotted)])).collect()}
    assert {(i, k) for i, _, items in texts for k in items} <= got
    assert not {i for i, _ in got} & {5, 7}


def test_names_anywhere_are_slots(spark):
    item = "Tom has 5 red apples. Tom buys 3 pears. Tom eats 2 figs. How many pieces of fruit does Tom have now?"
    other = "Where does a train go when it has left? A report on how many pieces of red fruit the men eat, and on what now buys apples, pears and figs"
    texts = {
        0: item, 1: item.replace("Tom", "Ann"), 2: item.replace("Tom", "Ann").replace("5 red", "7 red"), 3: item.upper(), 4: item.replace("Tom", "Mary Ann Lee").replace("3", "14"),
        5: "Some words before. " + item.replace("Tom", "Ann") + " And more after.", 6: item.lower(),
        7: item.replace("Tom buys", "Ann buys"), 8: other,
    }
    items = edge.benchmark(spark, [(0, item), (1, other)])
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.leaking_documents(edge.docs(spark, [(i, t, "s") for i, t in texts.items()]), items).collect()}
    assert got.pop((8, 1)) and {i for i, k in got if k == 0} == set(got_i for got_i, _ in got) == {0, 1, 2, 3, 4, 5, 6}
    assert got[0, 0] and not got[1, 0] and not got[2, 0]


def test_slots_are_one_to_one(spark):
    item = "the first of them gave 4 coins and the second of them gave 9 coins to the poor man who sat near the gate all day"
    same = item.replace("4", "6").replace("9", "6")
    docs = edge.docs(spark, [(0, item.replace("4", "6").replace("9", "8"), "s"), (1, same, "s")])
    assert {r["doc_id"] for r in decontaminate.leaking_documents(docs, edge.benchmark(spark, [(0, item)])).collect()} == {0}


def test_re_parameterised_items_leak(spark, small):
    """Items with names, numbers and units of their own, then with others in their places."""
    rng = np.random.default_rng(4)
    base = [r["text"].split() for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    syllables = ["ka", "lo", "mi", "ner", "zu", "tha", "bre", "qui"]
    names = ["".join(rng.choice(syllables, 3)).capitalize() for _ in range(600)]
    units = ["km", "kg", "miles", "hours", "days", "dollars", "liters"]

    def filled(words, who, numbers, unit):
        out, k = [], 0
        for i, w in enumerate(words):
            if i % 6 == 1:
                w = f"{numbers[k % len(numbers)]} {unit}"
                k += 1
            elif i % 9 == 4:
                w = who[k % len(who)]
            if i % 11 == 0:  # a sentence begins, now and then with a name
                w = (who[0] if i % 2 else w.capitalize())
                out[-1:] = [x + "." for x in out[-1:]]
            out.append(w)
        return " ".join(out)

    draw = lambda: ([str(x) for x in rng.choice(names, 2, replace=False)], rng.choice(1000, 7, replace=False).tolist(), units[rng.integers(len(units))])
    items = [(i, filled(w, *draw())) for i, w in enumerate(base) if len(w) >= 12]
    docs = [(i, "Before it stands this. " + filled(base[i], *draw()) + " After it comes more.", "s") for i, _ in items]
    clean = [(10_000 + r["doc_id"], r["text"], "s") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    clean = [r for r in clean if not any(" ".join(w[j : j + 5]).lower() in plain(r[1]) for w in base for j in range(0, len(w) - 5, 3))]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaking_documents(edge.docs(spark, docs + clean), edge.benchmark(spark, items)).collect()}
    assert sum((i, i) in got for i, _ in items) >= 0.9 * len(items)
    assert len({i for i, _ in got if i >= 10_000}) <= 0.01 * len(clean)
    assert all(i == k for i, k in got if i < 10_000)


def test_windows_are_worked_out_once(spark):
    texts = spark.createDataFrame([("one two three",), ("",), (" ".join("abcdefghij"),)], "text string")
    found = decontaminate.text_windows(texts.where("text is not null"), None)
    plan = found._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert plan.count("regexp_extract_all") == 1
    assert sorted(n for _, n in Counter((r["k1"], r["k2"]) for r in found.where("h is not null").collect()).items()) == [1, 3]
    assert found.where("h is null").count() == 1


def test_decontamination_of_nothing(spark):
    docs, items = edge.docs(spark), edge.benchmark(spark)
    assert decontaminate.remove_leaks(docs, items).count() == len(edge.ROWS)
    assert decontaminate.remove_leaks(docs, items.limit(0)).count() == len(edge.ROWS)
    assert decontaminate.leaking_documents(docs.limit(0), items).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def private_base(text):
    counts, out = [], []
    for kind, pattern in PATTERNS.items():
        found = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                found.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(found))
        out += found
    return counts, hashlib.sha256(",".join(out).encode()).hexdigest()


PRIVATE = [
    "a@b.com_x@y.org", "a@b@c.com x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.001", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111",
    "+1 (499) 555-6503 é +49 30 1234567 + ++123456789-", "é😀 joe@x.io, 10.0.0.1", "1.2.3 4.5.6.7", "1234567890123-4", "@@a@b.c..d",
    "9" * 5000, "a." * 3000 + "@x.y", "+1 " + "2 " * 4000, "111 4111111111111111",
]


def test_private_base(spark, small):
    awkward = edge.docs(spark, [(i, t, "s") for i, t in enumerate(PRIVATE)])
    for df in (awkward, edge.docs(spark), spark.read.parquet(f"{small}/documents.parquet")):
        want = Counter((r["doc_id"], *private_base(r["text"])[0], private_base(r["text"])[1]) for r in df.collect())
        got = sanitise.report(sanitise.find_private(df)).collect()
        assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    assert sanitise.report(sanitise.find_private(edge.docs(spark, []).limit(0))).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("a1.@+- 4(", max_size=40), min_size=1, max_size=30))
def test_private_base_on_random_text(spark, texts):
    got = sanitise.report(sanitise.find_entities(edge.docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).selectExpr("doc_id", "text")).selectExpr("*", "cast(array() as array<struct<s:int,e:int,action:string>>) as terms")).collect()
    for r in got:
        assert ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base_sha256"]) == private_base(texts[r["doc_id"]])


def test_texts_of_many_numbers(spark):
    import time

    took = []
    for n in (50_000, 200_000):
        rng = np.random.default_rng(n)
        text = ",".join(str(x) for x in rng.integers(0, 10**9, n)) + " 4111 1111 1111 1111 " + "joe@x.io +49 30 1234567 10.0.0.1 " * (n // 50)
        began = time.perf_counter()
        got = sanitise.report(sanitise.find_private(edge.docs(spark, [(0, text, "s")]))).collect()[0]
        took.append(time.perf_counter() - began)
        want = private_base(text)
        assert ([got["n_email"], got["n_ip"], got["n_card"], got["n_phone"]], got["base_sha256"]) == (want[0], want[1])
    assert took[1] < 4 * took[0] + 10


def test_terms_beside_addresses(spark):
    texts = ["éa@b.com Quorv a@b.com", "xé a@b.comé yy", "Quorvexia"]
    frame = edge.docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).select("doc_id", sanitise._terms(F.col("text")).alias("t"))
    got = {r["doc_id"]: [(x["s"], x["e"], x["term"]) for x in r["t"]] for r in frame.collect()}
    # a term that goes on in an address is left to it
    assert got == {0: [(9, 14, "quorv")], 1: [(0, 2, "xé"), (12, 14, "yy")], 2: [(0, 9, "quorvexia")]}


def test_disclosing_terms(spark):
    mail = [(i, f"Please ask secretary Quorvexia near zq@corp.org about common matters {i}", "s") for i in range(20)]
    rest = [(100 + i, f"Please ask someone about common matters like secretary work {i}", "s") for i in range(200)]
    got = {r["doc_id"]: r for r in sanitise.report(sanitise.find_private(edge.docs(spark, mail + rest))).collect()}
    text = mail[0][1]
    at = text.index("Quorvexia")
    assert f"term:{at}:{at + 9}" in got[0]["spans"] and f"term:{text.index('common')}" not in got[0]["spans"]
    assert all(got[i]["spans"] == "" for i, _, _ in rest)
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(edge.docs(spark, mail + rest)).collect()}
    assert "Quorvexia" not in clean[0] and "<EMAIL>" in clean[0] and clean[100] == rest[0][1]


def test_terms_of_an_entity_in_one_document(spark):
    far = "common words " * 400
    mail = [(0, f"Dr Ouz Quorvexia {far}asks zq@corp.org", "s")]
    rest = [(100 + i, f"asks common words {i}", "s") for i in range(200)]
    got = {r["doc_id"]: r for r in sanitise.report(sanitise.find_private(edge.docs(spark, mail + rest))).collect()}
    terms = [s for s in got[0]["spans"].split(",") if s.startswith("term")]
    assert terms == ["term:0:2", "term:3:6", "term:7:16"]  # names far away and short ones; not frequent words, nor parts of the entity
    assert all(got[i]["spans"] == "" for i, _, _ in rest)
    assert {r["doc_id"]: r["text"] for r in sanitise.sanitise(edge.docs(spark, mail + rest)).collect()}[0].strip() == far + "asks <EMAIL>"


def test_preferences_against_sql(spark, small):
    got = preference.preference_query(spark, small).toPandas()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    assert rows_of(got) == rows_of(con.execute(preference.PREFERENCE_SQL).fetchdf())


def test_preferences_awkward_rows(spark):
    rows = [
        (1, "chosen", 0, "user", "Q é"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "Q é"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 2, "user", None),
        (2, "chosen", 0, "user", None), (2, "rejected", 0, "user", ""), (3, "chosen", 0, "assistant", "alone"), (None, "chosen", 0, "user", "x"),
        (4, "chosen", 0, None, None), (4, "rejected", 0, None, None), (5, "chosen", 1, "user", "b"), (5, "chosen", 1, "user", "a"), (5, "rejected", 1, "user", "a"), (5, "rejected", 1, "user", "b"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").selectExpr("*", "'x' as prompt", "'y' as chosen")
    got = {r["pair_id"]: r for r in preference.format_preferences(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    r = got[1]
    assert (r["n_prompt_turns"], r["n_chosen_turns"], r["n_rejected_turns"]) == (1, 1, 2)
    a, b = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][a:b] == "good" and r["prompt"] == "<|user|>\nQ é\n" and r["rejected_mask"].count(":") == 1
    assert got[2]["n_prompt_turns"] == 0 and got[3]["rejected"] == "" and got[4]["n_prompt_turns"] == 1 and got[5]["n_prompt_turns"] == 2
    assert preference.format_preferences(df.limit(0)).count() == 0
