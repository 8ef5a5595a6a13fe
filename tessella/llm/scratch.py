"""Materialising intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset, a folder of the warehouse in local mode, where all
    tasks run on one machine; an error on a cluster, as tasks would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessella-intermediate"
        spark.conf.set("spark.checkpoint.dir", found)
        return found
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs its own tasks, never the plan
    before this point.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path  # noqa: SLF001
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``settle`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_tessella_path", None)
        if path:
            jvm = df.sparkSession._jvm  # noqa: SLF001
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)  # noqa: SLF001


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small: rows per batch, not bytes, are what Spark counts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def parts(spark: SparkSession) -> int:
    """How many pieces a keyed exchange is dealt into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
