"""Tables kept between steps: materialised intermediates, a cache by configuration, checkpoints."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  It must be set: a folder that only one machine sees would lose rows on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):  # all tasks run on this machine
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessella-intermediate"
        spark.conf.set("spark.checkpoint.dir", found)
        return found
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessella_path = path  # noqa: SLF001
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``settle`` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_tessella_path", None):
            remove(df.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)  # noqa: SLF001


def children(spark: SparkSession, path: str) -> list[str]:
    if not exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(p))  # noqa: SLF001


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)  # noqa: SLF001


def fingerprint(**config) -> str:
    """A key of all that a result depends on: pattern, special tokens, vocabulary size, the data's path ..."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=True).encode()).hexdigest()[:24]


class Cache:
    """Tables under ``root`` by kind and configuration.  A table counts once its _SUCCESS marker is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str, **config) -> str:
        return f"{self.root}/{kind}/{fingerprint(**config)}"

    def holds(self, kind: str, **config) -> bool:
        return exists(self.spark, f"{self.path(kind, **config)}/_SUCCESS")

    def save(self, df: DataFrame, kind: str, **config) -> None:
        df.write.mode("overwrite").parquet(self.path(kind, **config))

    def load(self, kind: str, **config) -> DataFrame | None:
        """The table, or None where there is none.  A damaged one fails when it is read."""
        return self.spark.read.parquet(self.path(kind, **config)) if self.holds(kind, **config) else None

    def load_or_compute(self, make: Callable[[], DataFrame], kind: str, renew: bool = False, **config) -> DataFrame:
        if renew or not self.holds(kind, **config):
            self.save(make(), kind, **config)
        return self.load(kind, **config)


class Checkpoints:
    """Training states by iteration under ``root``; one counts once its ``done`` table is written, last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, iteration: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{iteration}/{name}")
        self.spark.range(iteration, iteration + 1).toDF("iteration").write.mode("overwrite").parquet(f"{self.root}/{iteration}/done")

    def iterations(self) -> list[int]:
        names = (n for n in children(self.spark, self.root) if n.isdigit())
        return sorted(int(n) for n in names if exists(self.spark, f"{self.root}/{n}/done/_SUCCESS"))

    def nearest(self, target: int) -> int | None:
        return max((i for i in self.iterations() if i <= target), default=None)

    def load(self, iteration: int) -> dict[str, DataFrame] | None:
        if iteration not in self.iterations():
            return None
        names = [n for n in children(self.spark, f"{self.root}/{iteration}") if n != "done"]
        return {n: self.spark.read.parquet(f"{self.root}/{iteration}/{n}") for n in names}

    def load_or_initialize(self, target: int, make: Callable[[], dict[str, DataFrame]]) -> tuple[int, dict[str, DataFrame]]:
        at = self.nearest(target)
        return (at, self.load(at)) if at is not None else (0, make())

    def delete(self, iteration: int) -> bool:
        found = iteration in self.iterations()
        if found:
            remove(self.spark, f"{self.root}/{iteration}")
        return found
