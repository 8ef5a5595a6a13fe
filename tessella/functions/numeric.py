"""Numeric operators over arrays of doubles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def softmax(x: Column) -> Column:
    """Shifted by the maximum, so that large values do not overflow."""
    shifted = F.transform(F.array(x), lambda v: F.transform(v, lambda e: F.exp(e - F.array_max(v))))[0]
    return F.transform(F.array(shifted), lambda v: F.transform(v, lambda e: e / total(v)))[0]


def log_sum_exp(x: Column) -> Column:
    return F.transform(F.array(x), lambda v: F.array_max(v) + F.log(total(F.transform(v, lambda e: F.exp(e - F.array_max(v))))))[0]


def cross_entropy(logits: Column, target: Column) -> Column:
    """One row's loss; average over rows for the batch's.  ``target`` counts from 0."""
    return log_sum_exp(logits) - F.element_at(logits, target + 1)


def rms_norm(x: Column, weight: Column | None = None, eps: float = 1e-5) -> Column:
    scaled = F.transform(F.array(x), lambda v: F.transform(v, lambda e: e / F.sqrt(dot(v, v) / F.size(v) + eps)))[0]
    return scaled if weight is None else F.zip_with(scaled, weight, lambda a, w: a * w)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v * sigmoid(v))


def matrix(rows) -> Column:
    """A literal weight matrix, array<array<double>>, of a size fixed by the model's configuration."""
    return F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in rows))


def linear(x: Column, weight: Column) -> Column:
    """x times the transpose of ``weight`` (d_out rows of d_in); no bias."""
    return F.transform(weight, lambda row: dot(row, x))


def swiglu(x: Column, w1: Column, w2: Column, w3: Column) -> Column:
    """W2 (silu(W1 x) * W3 x); every weight has its outputs as rows."""
    return linear(F.zip_with(silu(linear(x, w1)), linear(x, w3), lambda a, b: a * b), w2)


def rope(x: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotary embedding of adjacent pairs (x0, x1), (x2, x3), ...: pair k turns by position / theta ** (2k / d)."""

    def of(v):
        def turn(e, i):
            k = F.floor(i / 2)
            angle = position / F.pow(F.lit(theta), 2 * k / F.size(v))
            other = F.get(v, (i + 1 - 2 * (i % 2)).cast("int"))
            return e * F.cos(angle) + F.when(i % 2 == 0, -other).otherwise(other) * F.sin(angle)

        return F.transform(v, turn)

    return F.transform(F.array(x), of)[0]


def cosine_lr(it: Column, most: float, least: float, warmup: int, cycle: int) -> Column:
    """Linear warm-up, cosine decay until ``cycle``, then the least rate."""
    half = F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(3.141592653589793) * (it - warmup) / (cycle - warmup)))
    return F.when(it < warmup, it / F.lit(float(warmup)) * most).when(it > cycle, F.lit(float(least))).otherwise(F.lit(float(least)) + half * (most - least))
