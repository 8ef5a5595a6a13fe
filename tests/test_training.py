"""Learning merges against a naive learner."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators.training import learn_in_rounds, learn_locally, round_of_merges, train


def word(raw: bytes) -> str:
    return "".join(f"<{b:02X}>" for b in raw)


def naive(counts, k):
    words = {tuple(bytes([b]) for b in w): c for w, c in counts.items()}
    out = []
    for _ in range(k):
        pairs = Counter()
        for w, c in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += c
        if not pairs:
            break
        (a, b), n = max(pairs.items(), key=lambda x: (x[1], x[0]))
        out.append((a.hex().upper(), b.hex().upper(), n))
        merged = Counter()
        for w, c in words.items():
            parts, i = [], 0
            while i < len(w):
                if w[i : i + 2] == (a, b):
                    parts.append(a + b)
                    i += 2
                else:
                    parts.append(w[i])
                    i += 1
            merged[tuple(parts)] += c
        words = merged
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=9).map(str.encode), st.integers(1, 6), min_size=1, max_size=12))
def test_local_learner(counts):
    assert learn_locally([(word(w), c) for w, c in counts.items()], 12) == naive(counts, 12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abcd", min_size=1, max_size=8).map(str.encode), st.integers(1, 4), min_size=1, max_size=10))
def test_rounds_choose_what_single_merges_would(counts):
    words = {tuple(bytes([b]) for b in w): c for w, c in counts.items()}
    expected, made = naive(counts, 20), []
    while len(made) < 20:
        pairs = Counter()
        for w, c in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += c
        ranking = [(a.hex().upper(), b.hex().upper(), n) for (a, b), n in sorted(pairs.items(), key=lambda x: (x[1], x[0]), reverse=True)]
        chosen = round_of_merges(ranking[:6], 20 - len(made), len(ranking) <= 6)
        if not chosen:
            break
        for a, b, _ in chosen:
            a, b = bytes.fromhex(a), bytes.fromhex(b)
            merged = Counter()
            for w, c in words.items():
                parts, i = [], 0
                while i < len(w):
                    if w[i : i + 2] == (a, b):
                        parts.append(a + b)
                        i += 2
                    else:
                        parts.append(w[i])
                        i += 1
                merged[tuple(parts)] += c
            words = merged
        made += chosen
    assert made == expected


def test_distributed_learner(spark):
    counts = {b"low": 5, b"lower": 2, b"newest": 6, b"widest": 3, b"aaaa": 4, b"aaab": 2}
    words = spark.createDataFrame([(word(w), c) for w, c in counts.items()], "word string, cnt long")
    assert learn_in_rounds(words, 15) == naive(counts, 15)


@pytest.mark.parametrize("local", [0, 1000])
def test_train_on_text(spark, local):
    docs = spark.createDataFrame([("a b ab ab<|endoftext|>ab abab",), (None,), ("",)], "text string")
    merges = train(docs, 257 + 3, ("<|endoftext|>",), local_words=local)
    counts = Counter([b"a", b" b", b" ab", b" ab", b"ab", b" abab"])
    assert merges == naive(counts, 3)


def test_vocabulary_smaller_than_bytes(spark):
    assert train(spark.createDataFrame([("abab",)], "text string"), 100) == []


def test_resume_from_merged_words():
    counts = {b"abcabc": 3, b"abab": 2}
    first = naive(counts, 2)
    words = [(word(w), c) for w, c in counts.items()]
    for a, b, _ in first:
        words = [(w.replace(f"<{a}><{b}>", f"<{a}{b}>"), c) for w, c in words]
    assert first + learn_locally(words, 3) == naive(counts, 5)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.text("abcd", min_size=1, max_size=8).map(str.encode), st.integers(1, 4), min_size=1, max_size=10), st.integers(1, 7), st.integers(1, 12), st.booleans())
def test_a_round_with_any_cut_and_any_number_left(counts, left, cut, known_complete):
    pairs = Counter()
    for w, c in counts.items():
        for a, b in zip(w, w[1:]):
            pairs[bytes([a]), bytes([b])] += c
    ranking = [(a.hex().upper(), b.hex().upper(), n) for (a, b), n in sorted(pairs.items(), key=lambda x: (x[1], x[0]), reverse=True)]
    chosen = round_of_merges(ranking[:cut], left, known_complete and len(ranking) <= cut)
    assert chosen == naive(counts, left)[: len(chosen)] and (chosen or not ranking) and len(chosen) <= left


def test_ties_end_a_round():
    assert round_of_merges([("64", "61", 1), ("63", "62", 1), ("61", "61", 1)], 2, True) == [("64", "61", 1)]


def test_merges_of_a_corpus_against_the_naive_learner(spark, small):
    import regex

    from tessella.functions.pretokens import GPT2_PATTERN

    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = Counter(t.encode() for r in docs.collect() for t in regex.findall(GPT2_PATTERN, r["text"] or ""))
    # the naive learner is slow: the commonest words, as documents of their own
    common = dict(counts.most_common(400))
    table = spark.createDataFrame([(w.decode(), n) for w, n in common.items()], "token string, n int").selectExpr("explode(array_repeat(token, n)) as text")
    want = naive(Counter({w: n for t, n in common.items() for w in [t]}), 243)
    pattern = r"(?s).+"
    assert train(table, 257 + 243, ("<|endoftext|>",), pattern=pattern) == want
    assert train(table, 257 + 40, ("<|endoftext|>",), pattern=pattern, local_words=0) == want[:40]


@pytest.mark.parametrize("local", [0, 1000])
def test_training_resumes_from_checkpoints(spark, tmp_path, local):
    from tessella.progress import Progress
    from tessella.sources.tables import Checkpoints

    docs = spark.createDataFrame([("banana bandana ananas cabana banal nab aaaa aaab",)] * 3 + [("banana aaa",)], "text string")
    whole = train(docs, 256 + 12, local_words=local)
    kept = Checkpoints(spark, str(tmp_path))
    with Progress(12) as progress:
        assert train(docs, 256 + 5, local_words=local, checkpoints=kept, every=2, progress=progress) == whole[:5]
    assert kept.iterations() and max(kept.iterations()) == 5
    assert train(docs, 256 + 12, local_words=local, checkpoints=kept, every=2) == whole
    assert train(docs, 256 + 12, local_words=1000 - local, checkpoints=kept, every=2) == whole
    assert train(docs, 256 + 4, local_words=local, checkpoints=kept) == whole[:4]
