"""Vocabularies: special tokens, then the 256 bytes, then merges in rank order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Cache


@dataclass(frozen=True)
class Vocabulary:
    """Merges in rank order and special tokens, together: one without the other gives wrong ids."""

    merges: tuple[tuple[str, str], ...]
    special_tokens: tuple[str, ...] = ()
    #: ids of tokens where they don't follow the standard layout
    ids: tuple[tuple[str, int], ...] = ()

    def rows(self) -> list[tuple[int, str]]:
        if self.ids:
            return [(i, t) for t, i in self.ids]
        tokens = [t.encode().hex().upper() for t in self.special_tokens] + [f"{b:02X}" for b in range(256)] + [a + b for a, b in self.merges]
        return list(enumerate(tokens))

    def id_of(self) -> dict[str, int]:
        """Token to id; of equal tokens the last id."""
        return {t: i for i, t in sorted(self.rows())}

    def token_of(self) -> dict[int, str]:
        return dict(self.rows())

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "token_id int, token string")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.merges)], "rank int, l string, r string")

    def save(self, cache: Cache, **config) -> None:
        specials = cache.spark.createDataFrame(list(enumerate(self.special_tokens)), "i int, token string")
        for kind, df in (("specials", specials), ("merges", self.merge_table(cache.spark)), ("vocabulary", self.table(cache.spark))):
            cache.save(df, kind, **config)

    @staticmethod
    def load(cache: Cache, **config) -> "Vocabulary | None":
        """From merges and special tokens; the vocabulary follows from them where its own table is missing."""
        merges, specials = cache.load("merges", **config), cache.load("specials", **config)
        if merges is None or specials is None:
            return None
        table = cache.load("vocabulary", **config)
        ids = tuple((r["token"], r["token_id"]) for r in table.collect()) if table is not None else ()
        return Vocabulary(tuple((r["l"], r["r"]) for r in merges.orderBy("rank").collect()), tuple(r["token"] for r in specials.orderBy("i").collect()), ids)


def reverse_vocabulary(table: DataFrame) -> DataFrame:
    """token, token_id: of equal tokens the last id."""
    return table.groupBy("token").agg(F.max("token_id").alias("token_id"))


def longest_merges(merges: DataFrame, count: int = 30) -> DataFrame:
    """rank, token, n_bytes of the longest merged tokens; ties in rank order."""
    token = F.concat("l", "r")
    sized = merges.select("rank", token.alias("token"), (F.length(token) / 2).cast("int").alias("n_bytes"))
    return sized.orderBy(F.desc("n_bytes"), "rank").limit(count)
