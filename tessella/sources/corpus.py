"""Corpora and vocabulary files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pretokens import END_OF_TEXT


def read_delimited(spark: SparkSession, path: str, delimiter: str = END_OF_TEXT, column: str = "text") -> DataFrame:
    """One row a document of a text file whose documents end at a delimiter; Spark splits the file by bytes itself,
    and a delimiter that straddles two splits is found."""
    return spark.read.option("lineSep", delimiter).text(path).withColumnRenamed("value", column)


def read_lines(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """One row a line, its newline kept, as a text file's iterator gives them."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.concat("value", F.lit("\n")).alias(column))


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 stays, the rest moves to 256, 257, ... in byte order."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


def printable_bytes(spark: SparkSession) -> DataFrame:
    """byte, code: the 256-row alphabet."""
    return spark.createDataFrame([(b, ord(c)) for b, c in sorted(byte_alphabet().items())], "byte int, code int")


def hex_of_printable(text: str) -> str:
    back = {c: b for b, c in byte_alphabet().items()}
    return bytes(back[c] for c in text).hex().upper()


def read_merges(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Merges of a merges file in rank order, as hex; lines that are not two parts are skipped.

    The file is as long as a vocabulary, so it is read whole on the driver.
    """
    rows = spark.read.option("lineSep", "\n").text(path, wholetext=True).first()
    pairs = (line.rstrip("\r").split(" ") for line in (rows[0] if rows else "").split("\n"))
    return [(hex_of_printable(p[0]), hex_of_printable(p[1])) for p in pairs if len(p) == 2 and all(p)]


def read_vocabulary(spark: SparkSession, path: str, special_tokens: Sequence[str] = ()) -> DataFrame:
    """token_id, token (hex) of a JSON object from printable token to id; missing special tokens come after the last."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("text", "token_id"))
    back = F.create_map(*(F.lit(x) for b, c in byte_alphabet().items() for x in (c, f"{b:02X}")))
    # a token that is a special token's text is that text, not printable bytes
    own = F.hex(F.encode("text", "UTF-8"))
    token = F.when(F.col("text").isin(*special_tokens), own).otherwise(F.array_join(F.transform(F.split("text", ""), lambda c: F.coalesce(back[c], F.lit(""))), "")) if special_tokens else F.array_join(F.transform(F.split("text", ""), lambda c: F.coalesce(back[c], F.lit(""))), "")
    vocab = raw.select("token_id", token.alias("token"))
    if not special_tokens:
        return vocab
    wanted = spark.createDataFrame([(i, t.encode().hex().upper()) for i, t in enumerate(special_tokens)], "i int, s string")
    missing = wanted.join(vocab, F.col("s") == F.col("token"), "left_anti").orderBy("i").collect()
    size = vocab.count()
    more = spark.createDataFrame([(size + j, r["s"]) for j, r in enumerate(missing)], "token_id int, token string")
    return vocab.unionByName(more)
