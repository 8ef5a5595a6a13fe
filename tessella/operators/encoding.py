"""Encoding and decoding.

Encoding runs over Arrow batches with a memo of pre-tokens a task: the merge list is as large as a
vocabulary and goes to each task once, texts are never shuffled, and a pre-token is merged once.  (Few
merges can also be folded in the JVM: ``encode_distinct``.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pretokens import GPT2_PATTERN, python_alternation
from ..functions.words import apply_merges, as_word, elements
from .vocabulary import Vocabulary

MEMO = 200_000


class Encoder:
    """Texts to ids in plain Python, as one task uses it.  Merges go by rank, one pass each: after a merge of some
    rank only higher ranks are looked at."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = GPT2_PATTERN):
        self.ids = {bytes.fromhex(t): i for t, i in vocabulary.id_of().items()}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, (a, b) in enumerate(vocabulary.merges):
            self.rank.setdefault((bytes.fromhex(a), bytes.fromhex(b)), i)
        self.special = {t: self.ids[t.encode()] for t in vocabulary.special_tokens}
        self.split = python_alternation(vocabulary.special_tokens)
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}

    def word(self, token: str) -> list[int]:
        found = self.memo.get(token)
        if found is None:
            parts = [bytes([b]) for b in token.encode()]
            done = -1
            while len(parts) > 1:
                best = min((r for r in map(self.rank.get, zip(parts, parts[1:])) if r is not None and r > done), default=None)
                if best is None:
                    break
                done, out, i = best, [], 0
                while i < len(parts):
                    if i + 1 < len(parts) and self.rank.get((parts[i], parts[i + 1])) == best:
                        out.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            if missing := [p for p in parts if p not in self.ids]:
                raise ValueError(f"no id for token {missing[0]!r}")
            found = [self.ids[p] for p in parts]
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for token in self.find(part):
                    out += self.word(token)
        return out

    def encode_iterable(self, texts: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of chunks, each encoded by itself, in bounded memory."""
        for text in texts:
            yield from self.encode(text)


def arrow_encoder(vocabulary: Vocabulary, pattern: str, column: str) -> Callable:
    def run(batches):
        encoder = Encoder(vocabulary, pattern)
        for b in batches:
            ids = [None if t is None else encoder.encode(t) for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, "ids"])

    return run


def encode(texts: DataFrame, vocabulary: Vocabulary, column: str = "text", pattern: str = GPT2_PATTERN) -> DataFrame:
    """All columns and ids (array<int>).  Null stays null; an empty text has no ids.  Also works on streams."""
    return texts.mapInArrow(arrow_encoder(vocabulary, pattern, column), texts.select("*").schema.add("ids", T.ArrayType(T.IntegerType())))


def encode_chunks(texts: DataFrame, vocabulary: Vocabulary, column: str = "text", **options) -> DataFrame:
    """Each line, newline included, encoded by itself as a text file's iterator would give it: chunk, chunk_text and
    ids.  Runs of newlines differ from whole-text encoding."""
    lines = F.regexp_extract_all(F.col(column), F.lit(r"(?s)[^\n]*\n|[^\n]+$"), F.lit(0))
    exploded = texts.select("*", F.posexplode(lines).alias("chunk", "chunk_text"))
    return encode(exploded, vocabulary, "chunk_text", **options)


def encode_distinct(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """token, ids of distinct pre-tokens with merges folded in the JVM, for short merge lists."""
    word = apply_merges(as_word(F.col("token")), vocabulary.merges)
    return tokens.select("token", F.transform(elements(word), lambda e: id_map(vocabulary)[e]).alias("ids"))


def id_map(vocabulary: Vocabulary) -> Column:
    return F.create_map(*(F.lit(x) for pair in vocabulary.id_of().items() for x in pair))


def token_rows(encoded: DataFrame, key: str) -> DataFrame:
    """key, pos, token_id."""
    return encoded.select(key, F.posexplode("ids").alias("pos", "token_id"))


def decode(ids: DataFrame, vocabulary: Vocabulary, errors: str = "replace", column: str = "ids") -> DataFrame:
    """All columns and decoded.  errors: replace, strict or ignore, as for bytes.  An unknown id fails."""
    tokens = {i: bytes.fromhex(t) for i, t in vocabulary.rows()}

    def run(batches):
        for b in batches:
            out = []
            for row in b.column(column).to_pylist():
                if row is not None and any(i not in tokens for i in row):
                    raise ValueError("an id is not in the vocabulary")
                out.append(None if row is None else b"".join(tokens[i] for i in row).decode(errors=errors))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    return ids.mapInArrow(run, ids.select("*").schema.add("decoded", "string"))


def round_trips(texts: DataFrame, vocabulary: Vocabulary, column: str = "text", **options) -> DataFrame:
    """All columns and ok: does decoding the encoded text give the text back."""
    both = decode(encode(texts, vocabulary, column, **options), vocabulary)
    return both.select(*texts.columns, F.col("decoded").eqNullSafe(F.col(column)).alias("ok"))


def token_total(encoded: DataFrame, token_id: int | None = None) -> DataFrame:
    """n: all tokens, or those with one id."""
    ids = F.col("ids") if token_id is None else F.filter("ids", lambda i: i == token_id)
    return encoded.agg(F.coalesce(F.sum(F.size(ids)), F.lit(0)).cast("long").alias("n"))


def id_array(ids: Iterable[int]) -> np.ndarray:
    return np.fromiter(ids, np.int64)
