"""Encoding streams: stateless, one chunk a row, appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.pretokens import GPT2_PATTERN
from ..operators.encoding import encode
from ..operators.vocabulary import Vocabulary


def encode_stream(chunks: DataFrame, vocabulary: Vocabulary, column: str = "text", pattern: str = GPT2_PATTERN) -> DataFrame:
    """The same encoding as in batch; memory is bounded by Arrow batches and the memo of pre-tokens."""
    return encode(chunks, vocabulary, column, pattern)


def watch_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def watch_lines(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """Lines of text files as they arrive, newlines kept, as a file's iterator gives them."""
    lines = spark.readStream.option("lineSep", "\n").text(path)
    return lines.select(F.concat("value", F.lit("\n")).alias(column))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream as Parquet, exactly once a chunk; what is there is processed, then the query ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
