"""Optimiser operators over parameter tables (name, i, value, grad)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Checkpoints


def clip_gradients(params: DataFrame, most: float, eps: float = 1e-6) -> DataFrame:
    """Scales grad so that its norm over all parameters is at most ``most``; null gradients stay null and don't count."""
    norm = params.agg(F.sqrt(F.coalesce(F.sum(F.col("grad") * F.col("grad")), F.lit(0.0))).alias("norm_"))
    scale = F.when(F.col("norm_") > most, F.lit(most) / (F.col("norm_") + eps)).otherwise(1.0)
    return params.crossJoin(F.broadcast(norm)).withColumn("grad", F.col("grad") * scale).drop("norm_")


def adamw_step(params: DataFrame, step: int, lr: float = 1e-3, decay: float = 0.01, betas=(0.9, 0.999), eps: float = 1e-8) -> DataFrame:
    """One update of (value, grad, m, v), ``step`` from 1.  Rows without a gradient stay as they are."""
    b1, b2 = betas
    m = b1 * F.col("m") + (1 - b1) * F.col("grad")
    v = b2 * F.col("v") + (1 - b2) * F.col("grad") * F.col("grad")
    rate = lr * math.sqrt(1 - b2**step) / (1 - b1**step)
    value = (F.col("value") - rate * m / (F.sqrt(v) + eps)) * (1 - lr * decay)
    has = F.col("grad").isNotNull()
    new = {"value": value, "m": m, "v": v}
    return params.withColumns({k: F.when(has, x).otherwise(F.col(k)) for k, x in new.items()})


@dataclass
class AdamW:
    """The same update over named numpy arrays, for models that fit one place; steps are sequential anyway."""

    lr: float = 1e-3
    decay: float = 0.01
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    step_count: int = 0

    def __post_init__(self):
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray | None]) -> None:
        self.step_count += 1
        b1, b2 = self.betas
        rate = self.lr * math.sqrt(1 - b2**self.step_count) / (1 - b1**self.step_count)
        for name, g in grads.items():
            if g is None:
                continue
            m = self.m[name] = b1 * self.m.get(name, 0.0) + (1 - b1) * g
            v = self.v[name] = b2 * self.v.get(name, 0.0) + (1 - b2) * g * g
            params[name] -= rate * m / (np.sqrt(v) + self.eps)
            params[name] *= 1 - self.lr * self.decay


def save_model(spark: SparkSession, root: str, iteration: int, params: dict[str, np.ndarray], optimizer: AdamW) -> None:
    """Weights, optimiser state and iteration as tables; the iteration counts once all are written."""
    rows = [(kind, n, list(a.shape), a.astype(float).ravel().tolist()) for kind, of in (("param", params), ("m", optimizer.m), ("v", optimizer.v)) for n, a in of.items()]
    table = spark.createDataFrame(rows, "kind string, name string, shape array<int>, data array<double>")
    settings = spark.createDataFrame([(optimizer.lr, optimizer.decay, *optimizer.betas, optimizer.eps, optimizer.step_count)], "lr double, decay double, b1 double, b2 double, eps double, step_count long")
    Checkpoints(spark, root).save(iteration, arrays=table, optimizer=settings)


def load_model(spark: SparkSession, root: str) -> tuple[int, dict[str, np.ndarray], AdamW]:
    """The newest complete checkpoint: iteration, weights, optimiser."""
    store = Checkpoints(spark, root)
    iteration = max(store.iterations())
    tables = store.load(iteration)
    s = tables["optimizer"].first()
    optimizer = AdamW(s["lr"], s["decay"], (s["b1"], s["b2"]), s["eps"], s["step_count"])
    params: dict[str, np.ndarray] = {}
    for r in tables["arrays"].collect():
        {"param": params, "m": optimizer.m, "v": optimizer.v}[r["kind"]][r["name"]] = np.array(r["data"]).reshape(r["shape"])
    return iteration, params, optimizer
