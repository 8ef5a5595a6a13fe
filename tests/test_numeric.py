"""Numeric operators against numpy, and the stores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import numeric
from tessella.functions.words import printable
from tessella.operators import model, optimizing, windows
from tessella.progress import Progress, clock
from tessella.sources.tables import Cache, Checkpoints

RNG = np.random.default_rng(4)


def one(spark, column, **arrays):
    df = spark.createDataFrame([tuple(a.tolist() for a in arrays.values())], ", ".join(f"{k} array<double>" for k in arrays))
    return np.array(df.select(column.alias("o")).first()["o"])


def test_softmax_and_losses_are_stable(spark):
    x = RNG.normal(size=7)
    for scale in (1, 1000):
        assert np.allclose(one(spark, numeric.softmax(F.col("x")), x=x * scale + 100), model.np_softmax(x * scale), atol=1e-9)
        got = one(spark, F.array(numeric.cross_entropy(F.col("x"), F.lit(2))), x=x * scale)
        want = np.log(np.exp(x * scale - (x * scale).max()).sum()) + (x * scale).max() - x[2] * scale
        assert np.allclose(got, want)


def test_rope_matches_numpy(spark):
    x = RNG.normal(size=8)
    assert np.allclose(one(spark, numeric.rope(F.col("x"), F.lit(5)), x=x), model.np_rope(x[None], np.array([5]))[0])


def test_attention_matches_numpy(spark):
    q = RNG.normal(size=(5, 4))
    rows = spark.createDataFrame([(0, i, *([r.tolist()] * 3)) for i, r in enumerate(q)], "s int, p int, q array<double>, k array<double>, v array<double>")
    for causal in (True, False):
        got = np.array([r["out"] for r in model.attention(rows, "s", "p", causal).orderBy("p").collect()])
        mask = np.tril(np.ones((5, 5), bool)) if causal else None
        assert np.allclose(got, model.np_attention(q, q, q, mask))


def test_missing_embedding_fails(spark):
    table = spark.createDataFrame([(0, [1.0])], "token_id int, vector array<double>")
    with pytest.raises(Exception):
        model.gather(spark.createDataFrame([(7,)], "token_id int"), table).collect()


def test_language_model_is_causal(spark):
    config = model.Config(50, 16, 8, 2, 2, 12)
    w = config.random_weights(3)
    ids = RNG.integers(0, 50, (2, 9))
    whole = model.np_language_model(ids, w, config)
    assert whole.shape == (2, 9, 50)
    assert np.allclose(model.np_language_model(ids[:, :4], w, config), whole[:, :4])
    with pytest.raises(ValueError):
        model.np_language_model(np.zeros((1, 17), int), w, config)
    df = spark.createDataFrame([(ids[0].tolist(),), ([],), (None,)], "ids array<int>")
    got = [r["logits"] for r in model.next_token_logits(df, w, config).collect()]
    assert np.allclose(got[0], whole[0, -1]) and got[1] is None and got[2] is None


def test_schedule(spark):
    df = spark.range(25).select(numeric.cosine_lr(F.col("id"), 1.0, 0.1, 7, 21).alias("r"))
    got = [r["r"] for r in df.collect()]
    assert got[0] == 0 and got[7] == 1 and math.isclose(got[14], 0.55) and got[21:] == pytest.approx([0.1] * 4)


def test_adamw_forms_agree(spark):
    value, grads = RNG.normal(size=4), [RNG.normal(size=4) for _ in range(3)]
    opt, params = optimizing.AdamW(lr=0.1), {"w": value.copy()}
    df = spark.createDataFrame([(i, float(v), 0.0, 0.0) for i, v in enumerate(value)], "i int, value double, m double, v double")
    for step, g in enumerate(grads, 1):
        opt.step(params, {"w": g, "frozen": None})
        given = spark.createDataFrame([(i, float(x)) for i, x in enumerate(g)], "i int, grad double")
        df = optimizing.adamw_step(df.join(given, "i"), step, lr=0.1).drop("grad")
    assert np.allclose([r["value"] for r in df.orderBy("i").collect()], params["w"])


def test_clipping_skips_missing_gradients(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 4.0), (2, None)], "i int, grad double")
    got = [r["grad"] for r in optimizing.clip_gradients(df, 1.0).orderBy("i").collect()]
    assert got[:2] == pytest.approx([0.6, 0.8], abs=1e-5) and got[2] is None


def test_model_checkpoint(spark, tmp_path):
    opt, params = optimizing.AdamW(), {"a": RNG.normal(size=(2, 3)), "b": RNG.normal(size=4)}
    opt.step(params, {k: np.ones_like(v) for k, v in params.items()})
    optimizing.save_model(spark, str(tmp_path), 10, params, opt)
    it, back, o = optimizing.load_model(spark, str(tmp_path))
    assert it == 10 and o.step_count == 1 and all(np.allclose(back[k], params[k]) and np.allclose(o.m[k], opt.m[k]) for k in params)


def test_random_batches(spark):
    data = spark.range(100).select(F.col("id").alias("pos"), F.col("id").alias("token_id"))
    rows = [r for s in range(3) for r in windows.random_batch(data, 32, 7, s).collect()]
    assert all(len(r["x"]) == 7 and [a + 1 for a in r["x"]] == r["y"] and 0 <= r["start"] <= 92 for r in rows) and len(rows) == 96
    with pytest.raises(ValueError):
        windows.random_batch(data, 1, 7, 0, device="cuda:99")


def test_windows_of_short_sequences(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4],), ([],), (None,)], "ids array<int>")
    assert [(r["x"], r["y"]) for r in windows.lm_windows(df, 3, 1).collect()] == [([1, 2, 3], [2, 3, 4])]


def test_cache(spark, tmp_path):
    cache, calls = Cache(spark, str(tmp_path)), []

    def make():
        calls.append(1)
        return spark.range(3)

    assert cache.load("t", pattern="x") is None
    assert cache.load_or_compute(make, "t", pattern="x").count() == 3
    cache.load_or_compute(make, "t", pattern="x")
    cache.load_or_compute(make, "t", pattern="y")
    cache.load_or_compute(make, "t", renew=True, pattern="x")
    assert len(calls) == 3


def test_checkpoints(spark, tmp_path):
    store = Checkpoints(spark, str(tmp_path))
    assert store.nearest(5) is None and store.load(3) is None
    assert store.load_or_initialize(9, lambda: {"w": spark.range(1)})[0] == 0
    for i in (3, 12):
        store.save(i, words=spark.range(i))
    assert store.iterations() == [3, 12] and store.nearest(11) == 3
    assert store.load(3)["words"].count() == 3 and store.load_or_initialize(20, dict)[0] == 12
    assert store.delete(3) and not store.delete(3) and store.iterations() == [12]


def test_printable_and_progress(spark):
    df = spark.createDataFrame([("6869",), ("FF",)], "t string").select(printable(F.col("t")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["hi", "<bytes: ff>"]
    assert clock(3725) == "1 hr 2 min" and clock(59.9) == "0 min 59 sec"
    with Progress(total=10) as p:
        p.start("a")
        p.stop("a")
        assert p.report(10)
    assert p.summary()["total"] == 100


def plain_model(ids, w, c):
    """The language model in plain Python: lists, loops, and complex numbers for the rotations."""
    import cmath
    import math

    times = lambda m, x: [sum(a * b for a, b in zip(row, x)) for row in m]
    norm = lambda x, g: [a / math.sqrt(sum(b * b for b in x) / len(x) + c.eps) * k for a, k in zip(x, g)]
    size = c.d_model // c.num_heads

    def rotated(x, at):
        out = []
        for i in range(0, size, 2):
            z = complex(x[i], x[i + 1]) * cmath.exp(1j * at / c.rope_theta ** (i / size))
            out += [z.real, z.imag]
        return out

    xs = [list(w["token_embeddings.weight"][t]) for t in ids]
    for layer in range(c.num_layers):
        g = lambda n, layer=layer: w[f"layers.{layer}.{n}.weight"]
        normed = [norm(x, g("ln1")) for x in xs]
        q, k, v = ([times(g(f"attn.{n}_proj"), x) for x in normed] for n in "qkv")
        mixed = []
        for i in range(len(xs)):
            heads = []
            for h in range(c.num_heads):
                part = slice(h * size, (h + 1) * size)
                scores = [sum(a * b for a, b in zip(rotated(q[i][part], i), rotated(k[j][part], j))) / math.sqrt(size) for j in range(i + 1)]
                e = [math.exp(s - max(scores)) for s in scores]
                heads += [sum(e[j] * v[j][part][d] for j in range(i + 1)) / sum(e) for d in range(size)]
            mixed.append(times(g("attn.output_proj"), heads))
        xs = [[a + b for a, b in zip(x, m)] for x, m in zip(xs, mixed)]
        for n, x in enumerate(xs):
            y = norm(x, g("ln2"))
            gate = [a / (1 + math.exp(-a)) * b for a, b in zip(times(g("ffn.w1"), y), times(g("ffn.w3"), y))]
            xs[n] = [a + b for a, b in zip(x, times(g("ffn.w2"), gate))]
    return [times(w["lm_head.weight"], norm(x, w["ln_final.weight"])) for x in xs]


def test_language_model_against_plain_python(spark):
    import numpy as np

    from tessella.operators import model

    c = model.Config(vocab_size=30, context_length=9, d_model=16, num_layers=3, num_heads=4, d_ff=24)
    rng = np.random.default_rng(7)
    w = {n: rng.normal(0, 0.4, x.shape) for n, x in c.random_weights(1).items()}
    ids = [3, 17, 0, 29, 3, 8, 8]
    want = plain_model(ids, w, c)
    assert np.allclose(model.np_language_model(np.array(ids), w, c), want, atol=1e-9)
    assert np.allclose(model.np_language_model(np.array([ids, ids[::-1]]), w, c)[1], plain_model(ids[::-1], w, c), atol=1e-9)
    df = spark.createDataFrame([(0, ids), (1, ids[:1]), (2, []), (3, None)], "i int, ids array<int>")
    got = {r["i"]: r["logits"] for r in model.next_token_logits(df, w, c).collect()}
    assert np.allclose(got[0], want[-1], atol=1e-9) and np.allclose(got[1], want[0], atol=1e-9) and got[2] is None and got[3] is None
    # one block and multi-head attention without rotations
    x = rng.normal(0, 1, (5, 16))
    heads = lambda t: model.np_self_attention(t, *(w[f"layers.0.attn.{n}_proj.weight"] for n in ("q", "k", "v", "output")), 4)
    order = [2, 0, 1, 3, 4]
    assert np.allclose(heads(x)[3:], heads(x[order])[3:])  # without positions the order of what came before is nothing


def test_attention_with_a_general_mask(spark):
    import numpy as np

    from tessella.operators import model

    rng = np.random.default_rng(5)
    q, k, v = (rng.normal(0, 1, (2, 6, 4)) for _ in range(3))
    seen = rng.random((2, 6, 6)) < 0.5
    seen[:, np.arange(6), np.arange(6)] = True
    rows = spark.createDataFrame([(s, i, q[s, i].tolist(), k[s, i].tolist(), v[s, i].tolist()) for s in range(2) for i in range(6)], "seq int, pos int, q array<double>, k array<double>, v array<double>")
    mask = spark.createDataFrame([(s, i, j) for s in range(2) for i in range(6) for j in range(6) if seen[s, i, j]], "seq int, pos int, seen int")
    for causal in (False, True):
        got = {(r["seq"], r["pos"]): r["out"] for r in model.attention(rows, "seq", "pos", causal, mask).collect()}
        both = seen & np.tril(np.ones((6, 6), bool)) if causal else seen
        want = model.np_attention(q, k, v, both)
        assert all(np.allclose(got[s, i], want[s, i]) for s in range(2) for i in range(6))
