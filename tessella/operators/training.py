"""Learning merges.

``train`` counts words with Spark and then learns merges in one of two exact ways: in one place over
flat numpy arrays while the distinct words are few, or with DataFrame rounds beyond that.

A round takes the ranking of pairs and applies several merges at once.  Going down the ranking, it
stops at the first pair that shares a token with a chosen one.  New pairs contain a merged token and a
neighbour; such a pair can't be more frequent than the old pair of that neighbour, which shares a token
and so ranks at the stop or below.  Chosen pairs that are strictly more frequent than the pair after them
are therefore exactly what one merge at a time would choose, whatever ends the round: a shared token, the
number of merges still wanted, or the end of the ranking.  (A pair of equal tokens can make a pair out of
itself, so it is the last of its round.)
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pretokens import GPT2_PATTERN
from ..functions.words import apply_merges, as_word
from ..progress import Progress
from ..sources.tables import Checkpoints, discard, settle
from .counting import pair_counts, token_counts

#: Up to so many distinct words are learned from in one place (some 100 MB).
LOCAL_WORDS = 1_000_000
#: Pairs looked at in one distributed round.
RANKING = 256

Merge = tuple[str, str, int]


@dataclass(frozen=True)
class TrainingState:
    """Merges so far, and words with these merges applied (None where they follow from the corpus)."""

    merges: list[Merge]
    words: DataFrame | None


def merges_needed(vocab_size: int, special_tokens: Sequence[str]) -> int:
    return max(0, vocab_size - 256 - len(special_tokens))


def _last_first(token: bytes) -> tuple[int, ...]:
    """Sorts ascending where the bytes sort descending."""
    return (*(255 - b for b in token), 256)


class FlatWords:
    """All words as one flat array of token ids with gaps between them.

    A merge is a few vector operations; pair counts change by what stands beside its occurrences.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray, names: list[bytes]):
        at = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths) + 1
        self.ids = np.full(int(lengths.sum() + len(lengths)) + 1, -1, np.int32)
        self.ids[at] = ids
        self.weight = np.zeros(len(self.ids), np.int64)
        self.weight[at] = np.repeat(counts, lengths)
        self.names = names

    @staticmethod
    def of_hex(words: Sequence[tuple[str, int]]) -> "FlatWords":
        """From (bracketed hex word, count) rows, whose elements may be merged already."""
        names: list[bytes] = [bytes([i]) for i in range(256)]
        known = {n: i for i, n in enumerate(names)}
        ids: list[int] = []
        lengths = []
        for w, _ in words:
            parts = [bytes.fromhex(x) for x in w[1:-1].split("><")] if w else []
            for p in parts:
                if p not in known:
                    known[p] = len(names)
                    names.append(p)
            ids += [known[p] for p in parts]
            lengths.append(len(parts))
        return FlatWords(np.array(ids, np.int32), np.array(lengths, np.int64), np.array([c for _, c in words], np.int64), names)

    @staticmethod
    def of_tokens(table: pa.Table) -> "FlatWords":
        """From an Arrow table of token (string) and cnt; no object is made for a word."""
        token = table.column("token").cast(pa.large_binary()).combine_chunks()
        token = token.chunk(0) if isinstance(token, pa.ChunkedArray) and token.num_chunks else token
        if not len(token):
            return FlatWords(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), [bytes([i]) for i in range(256)])
        _, offs, raw = token.buffers()
        edges = np.frombuffer(offs, np.int64)[token.offset : token.offset + len(token) + 1]
        data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw is not None else np.zeros(0, np.uint8)
        return FlatWords(data.astype(np.int32), np.diff(edges), table.column("cnt").to_numpy(), [bytes([i]) for i in range(256)])

    @staticmethod
    def _tally(left: np.ndarray, right: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (left >= 0) & (right >= 0)
        key, which = np.unique(left[ok].astype(np.int64) << 32 | right[ok].astype(np.int64), return_inverse=True)
        return key, np.bincount(which, by[ok], len(key)).astype(np.int64)

    def pairs(self) -> dict[int, int]:
        key, n = self._tally(self.ids[:-1], self.ids[1:], self.weight[:-1])
        return dict(zip(key.tolist(), n.tolist()))

    def _beside(self, at: np.ndarray, offsets: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the pairs that begin at the given offsets from ``at``, each place once."""
        places = np.unique(np.clip(np.concatenate([at + d for d in offsets]), 0, max(len(self.ids) - 2, 0)))
        return self._tally(self.ids[places], self.ids[places + 1], self.weight[places])

    def merge(self, left: int, right: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Apply a merge; the counts of the pairs beside its occurrences before and after."""
        ids = self.ids
        at = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right))
        if left == right and len(at):  # in a run, every other one
            start = np.concatenate([[True], np.diff(at) != 1])
            first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        new = len(self.names)
        self.names.append(self.names[left] + self.names[right])
        old = self._beside(at, (-1, 0, 1))
        ids[at] = new
        ids[at + 1] = -2
        keep = ids != -2
        self.ids, self.weight = ids[keep], self.weight[keep]
        return old, self._beside(at - np.arange(len(at)), (-1, 0))

    def replay(self, merges: Sequence[Merge]) -> None:
        """Apply merges that were learned before; token names take the ids that learning gave them."""
        known = {n: i for i, n in reversed(list(enumerate(self.names)))}
        for a, b, _ in merges:
            left, right = known[bytes.fromhex(a)], known[bytes.fromhex(b)]
            self.merge(left, right)
            known.setdefault(self.names[-1], len(self.names) - 1)


def learn_flat(words: FlatWords, count: int, done: Sequence[Merge] = (), after: Callable[[list[Merge]], None] | None = None) -> list[Merge]:
    """Merges (l, r, cnt) in rank order, ``done`` included."""
    words.replay(done)
    names = words.names
    counts = words.pairs()
    order = lambda k: (_last_first(names[k >> 32]), _last_first(names[k & 0xFFFFFFFF]))
    heap = [(-c, *order(k), k) for k, c in counts.items()]
    heapq.heapify(heap)
    merges: list[Merge] = list(done)
    while len(merges) < count and heap:
        negative, *_, k = heapq.heappop(heap)
        now = counts.get(k, 0)
        if now != -negative:
            if now > 0:
                heapq.heappush(heap, (-now, *order(k), k))
            continue
        if now <= 0:
            continue
        left, right = k >> 32, k & 0xFFFFFFFF
        merges.append((names[left].hex().upper(), names[right].hex().upper(), int(now)))
        old, fresh = words.merge(left, right)
        for sign, (keys, sizes) in ((-1, old), (1, fresh)):
            for p, c in zip(keys.tolist(), sizes.tolist()):
                counts[p] = counts.get(p, 0) + sign * c
        for p in {*old[0].tolist(), *fresh[0].tolist()}:
            if counts[p] > 0:
                heapq.heappush(heap, (-counts[p], *order(p), p))
            else:
                del counts[p]
        if after:
            after(merges)
    return merges


def learn_locally(words: Sequence[tuple[str, int]], count: int) -> list[Merge]:
    """Merges (l, r, cnt) in rank order from (bracketed hex word, count) rows."""
    return learn_flat(FlatWords.of_hex(words), count)


def round_of_merges(ranking: Sequence[Merge], left: int, complete: bool) -> list[Merge]:
    """The merges that one round may apply, from pairs in descending (cnt, l, r) order."""
    chosen: list[Merge] = []
    used: set[str] = set()
    # what comes after the ranking may be as frequent as its end
    next_count = 0 if complete or not ranking else ranking[-1][2]
    for a, b, c in ranking:
        itself = bool(chosen) and chosen[-1][0] == chosen[-1][1]
        if len(chosen) == left or itself or a in used or b in used:
            next_count = c
            break
        chosen.append((a, b, c))
        used |= {a, b}
    while len(chosen) > 1 and chosen[-1][2] <= next_count:
        chosen.pop()
    return chosen


def learn_in_rounds(words: DataFrame, count: int, done: Sequence[Merge] = (), checkpoint: Callable[[TrainingState], None] | None = None) -> list[Merge]:
    """Merges in rank order with distributed rounds; ``words`` already has the merges of ``done`` applied."""
    merges = list(done)
    now = settle(words.where(F.contains("word", F.lit("><"))), "words")
    while len(merges) < count:
        top = pair_counts(now).orderBy(F.desc("cnt"), F.desc("l"), F.desc("r")).limit(RANKING).collect()
        chosen = round_of_merges([(r["l"], r["r"], r["cnt"]) for r in top], count - len(merges), len(top) < RANKING)
        if not chosen:
            break
        merges += chosen
        word = F.col("word")
        for a, b, _ in chosen:
            word = F.replace(word, F.lit(f"<{a}><{b}>"), F.lit(f"<{a}{b}>"))
        before, now = now, settle(now.select(word.alias("word"), "cnt").where(F.contains("word", F.lit("><"))), "words")
        discard(before)
        if checkpoint:
            checkpoint(TrainingState(list(merges), now))
    discard(now)
    return merges


def learn(words: DataFrame, count: int, local_words: int = LOCAL_WORDS, checkpoint: Callable[[TrainingState], None] | None = None) -> list[Merge]:
    """``count`` merges (fewer where pairs run out), each the pair with the largest (cnt, l, r) at its time."""
    rows = words.select("word", "cnt").limit(local_words + 1).collect() if local_words else []
    if local_words and len(rows) <= local_words:
        after = (lambda merges: checkpoint(TrainingState(list(merges), None))) if checkpoint else None
        return learn_flat(FlatWords.of_hex([(r["word"], r["cnt"]) for r in rows]), count, after=after)
    return learn_in_rounds(words, count, checkpoint=checkpoint)


def _saver(checkpoints: Checkpoints, every: int, count: int, start: int):
    """Saves a state whenever ``every`` merges have come since the last one, and at the end."""
    spark, last = checkpoints.spark, [start]

    def save(state: TrainingState) -> None:
        n = len(state.merges)
        if n - last[0] >= every or n >= count > last[0]:
            tables = {"merges": spark.createDataFrame([(i, *m) for i, m in enumerate(state.merges)], "rank int, l string, r string, cnt long")}
            checkpoints.save(n, **tables, **({"words": state.words} if state.words is not None else {}))
            last[0] = n

    return save


def train(
    texts: DataFrame, vocab_size: int, special_tokens: Sequence[str] = (), pattern: str = GPT2_PATTERN, column: str = "text", local_words: int = LOCAL_WORDS,
    checkpoints: Checkpoints | None = None, every: int = 500, progress: Progress | None = None,
) -> list[Merge]:
    """Merges learned from a column of texts.

    With ``checkpoints`` (a folder of this corpus, pattern and special tokens) the state is saved every so many
    merges, and training goes on from the nearest saved state that isn't beyond the wanted number.
    """
    count = merges_needed(vocab_size, special_tokens)
    if not count:
        return []
    start = checkpoints.nearest(count) if checkpoints else None
    saved = checkpoints.load(start) if start else {}
    done: list[Merge] = [(r["l"], r["r"], r["cnt"]) for r in saved["merges"].orderBy("rank").collect()] if saved else []
    save = _saver(checkpoints, every, count, len(done)) if checkpoints else None
    tell = (lambda n: progress.report(n)) if progress else (lambda n: None)
    # one-byte tokens have no pair; their length is known before any work is done on them
    tokens = token_counts(texts, column=column, pattern=pattern, special_tokens=special_tokens, least_bytes=2)

    def state(s: TrainingState) -> None:
        tell(len(s.merges))
        if save:
            save(s)

    rows = tokens.limit(local_words + 1).toArrow() if local_words else None
    if rows is not None and rows.num_rows <= local_words:
        return learn_flat(FlatWords.of_tokens(rows), count, done, lambda merges: state(TrainingState(merges, None)))
    words = saved.get("words") if saved else None
    if words is None:
        words = tokens.select(apply_merges(as_word(F.col("token")), [m[:2] for m in done]).alias("word"), "cnt")
    return learn_in_rounds(words, count, done, state)
