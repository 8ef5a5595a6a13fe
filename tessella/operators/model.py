"""Transformer operators.

Sequences of rows are joined and aggregated with DataFrame functions; a whole model runs over Arrow
batches with numpy, its weights (of a configured, not a data-dependent, size) sent to each task once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import dot, softmax


def gather(tokens: DataFrame, table: DataFrame, total_check: bool = True) -> DataFrame:
    """Embedding lookup: ``tokens`` (.., token_id) joined with ``table`` (token_id, vector).  An id without a row fails."""
    out = tokens.join(table, "token_id", "left")
    if not total_check:
        return out
    lost = F.raise_error(F.concat(F.lit("no embedding for token "), F.col("token_id").cast("string")))
    return out.withColumn("vector", F.when(F.col("vector").isNull(), lost.cast(table.schema["vector"].dataType)).otherwise(F.col("vector")))


def attention(rows: DataFrame, key: str, pos: str, causal: bool = True, mask: DataFrame | None = None) -> DataFrame:
    """Scaled dot-product attention within each sequence: key, pos, out.

    ``rows`` has q, k, v arrays.  With ``causal`` a query sees keys at its position or before.  ``mask`` (key, pos,
    seen), if given, lists the positions that each query may look at besides; a query that sees nothing has no row.  A
    query's keys are one group: sequences are bounded by the model's context.
    """
    left = rows.select(key, F.col(pos).alias("i_"), "q")
    right = rows.select(F.col(key).alias("key_"), F.col(pos).alias("j_"), "k", "v")
    on = (F.col(key) == F.col("key_")) & ((F.col("j_") <= F.col("i_")) if causal else F.lit(True))
    pairs = left.join(right, on)
    if mask is not None:
        allowed = mask.select(F.col(key).alias("m_key_"), F.col(pos).alias("m_i_"), F.col("seen").alias("m_j_"))
        pairs = pairs.join(allowed, (F.col(key) == F.col("m_key_")) & (F.col("i_") == F.col("m_i_")) & (F.col("j_") == F.col("m_j_")), "left_semi")
    scored = pairs.select(key, "i_", "j_", (dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q"))).alias("score_"), "v")
    by = scored.groupBy(key, F.col("i_").alias(pos)).agg(F.array_sort(F.collect_list(F.struct("j_", F.col("score_").alias("s"), "v"))).alias("all"))
    weights = by.select(key, pos, softmax(F.transform("all", lambda x: x["s"])).alias("w"), F.transform("all", lambda x: x["v"]).alias("vs"))
    size = F.size(F.col("vs")[0])
    out = F.transform(F.sequence(F.lit(0), size - 1), lambda d: F.aggregate(F.zip_with("w", "vs", lambda w, v: w * F.get(v, d)), F.lit(0.0), lambda a, x: a + x))
    return weights.select(key, pos, out.alias("out"))


@dataclass(frozen=True)
class Config:
    """Sizes of a pre-norm decoder."""

    vocab_size: int
    context_length: int
    d_model: int
    num_layers: int
    num_heads: int
    d_ff: int
    rope_theta: float = 10000.0
    eps: float = 1e-5

    def random_weights(self, seed: int = 0) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        make = lambda *shape: rng.normal(0, 0.02, shape)
        out = {"token_embeddings.weight": make(self.vocab_size, self.d_model), "ln_final.weight": np.ones(self.d_model), "lm_head.weight": make(self.vocab_size, self.d_model)}
        for i in range(self.num_layers):
            p = f"layers.{i}."
            out |= {f"{p}attn.{n}_proj.weight": make(self.d_model, self.d_model) for n in ("q", "k", "v", "output")}
            out |= {f"{p}ln{n}.weight": np.ones(self.d_model) for n in (1, 2)}
            out |= {f"{p}ffn.w1.weight": make(self.d_ff, self.d_model), f"{p}ffn.w2.weight": make(self.d_model, self.d_ff), f"{p}ffn.w3.weight": make(self.d_ff, self.d_model)}
        return out


def np_softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def np_rms_norm(x: np.ndarray, weight: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * weight


def np_silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def np_swiglu(x, w1, w2, w3) -> np.ndarray:
    return (np_silu(x @ w1.T) * (x @ w3.T)) @ w2.T


def np_attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """mask is true where a query may look."""
    s = q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
    if mask is not None:
        s = np.where(mask, s, -np.inf)
    return np_softmax(s) @ v


def np_rope(x: np.ndarray, positions: np.ndarray, theta: float = 10000.0) -> np.ndarray:
    """Rotates adjacent pairs."""
    d = x.shape[-1]
    angle = positions[..., None] / theta ** (np.arange(0, d, 2) / d)
    c, s = np.cos(angle), np.sin(angle)
    out = np.empty_like(x)
    out[..., 0::2] = x[..., 0::2] * c - x[..., 1::2] * s
    out[..., 1::2] = x[..., 0::2] * s + x[..., 1::2] * c
    return out


def np_self_attention(x, wq, wk, wv, wo, heads: int, theta: float | None = None, positions=None) -> np.ndarray:
    """Causal multi-head self-attention over (..., sequence, d_model); with ``theta``, rotary positions."""
    n, d = x.shape[-2:]
    split = lambda y: np.swapaxes(y.reshape(*y.shape[:-1], heads, d // heads), -2, -3)
    q, k, v = (split(x @ w.T) for w in (wq, wk, wv))
    if theta is not None:
        at = np.arange(n) if positions is None else positions
        q, k = np_rope(q, at, theta), np_rope(k, at, theta)
    out = np_attention(q, k, v, np.tril(np.ones((n, n), bool)))
    return np.swapaxes(out, -2, -3).reshape(*x.shape[:-1], d) @ wo.T


def np_block(x, w: dict[str, np.ndarray], prefix: str, heads: int, theta: float | None, eps: float = 1e-5) -> np.ndarray:
    get = lambda n: w[f"{prefix}{n}.weight"]
    x = x + np_self_attention(np_rms_norm(x, get("ln1"), eps), get("attn.q_proj"), get("attn.k_proj"), get("attn.v_proj"), get("attn.output_proj"), heads, theta)
    return x + np_swiglu(np_rms_norm(x, get("ln2"), eps), get("ffn.w1"), get("ffn.w2"), get("ffn.w3"))


def np_language_model(ids: np.ndarray, w: dict[str, np.ndarray], config: Config) -> np.ndarray:
    """Unnormalised logits (.., sequence, vocab_size)."""
    if ids.shape[-1] > config.context_length:
        raise ValueError("the sequence is longer than the context")
    x = w["token_embeddings.weight"][ids]
    for i in range(config.num_layers):
        x = np_block(x, w, f"layers.{i}.", config.num_heads, config.rope_theta, config.eps)
    return np_rms_norm(x, w["ln_final.weight"], config.eps) @ w["lm_head.weight"].T


def next_token_logits(sequences: DataFrame, weights: dict[str, np.ndarray], config: Config, column: str = "ids") -> DataFrame:
    """All columns and logits of the last position of each sequence; an empty or null sequence has none."""
    sent = sequences.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in batches:
            rows = b.column(column).to_pylist()
            out = [np_language_model(np.array(r), sent.value, config)[-1].tolist() if r else None for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], [*b.schema.names, "logits"])

    return sequences.mapInArrow(run, sequences.select("*").schema.add("logits", T.ArrayType(T.DoubleType())))
