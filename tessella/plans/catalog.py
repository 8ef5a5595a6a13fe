"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, numeric
from ..functions.pretokens import END_OF_TEXT, GPT5_PATTERN, pieces, segments
from ..functions.words import as_word, printable
from ..operators import counting, encoding, model, optimizing, vocabulary, windows
from ..operators.training import train
from ..sources.corpus import printable_bytes
from . import sql

#: Merges that the vocabulary queries learn.
K = 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(spark: SparkSession, sf_dir: str, k: int = K) -> vocabulary.Vocabulary:
    merges = train(_table(spark, sf_dir, "documents"), 257 + k, (END_OF_TEXT,))
    return vocabulary.Vocabulary(tuple((a, b) for a, b, _ in merges), (END_OF_TEXT,))


# Counting


@query(sql.words())
def word_counts(spark, sf_dir):
    return counting.word_counts(_table(spark, sf_dir, "documents"))


@query(f"select count(*) n_unique, cast(coalesce(sum(cnt), 0) as bigint) n_total from ({sql.words()})")
def unique_word_stats(spark, sf_dir):
    return counting.totals(word_counts(spark, sf_dir))


@query()
def gpt5_word_counts(spark, sf_dir):
    return counting.word_counts(_table(spark, sf_dir, "documents"), pattern=GPT5_PATTERN)


@query(f"select tok token, cnt from (select tok, count(*) cnt from ({sql.tokens('documents', 'doc_id')}) group by tok) order by cnt desc, tok limit 50")
def top_words(spark, sf_dir):
    return counting.token_counts(_table(spark, sf_dir, "documents")).orderBy(F.desc("cnt"), "token").limit(50)


@query(sql.pairs(f"({sql.words()})"))
def pair_counts(spark, sf_dir):
    return counting.pair_counts(word_counts(spark, sf_dir))


@query(f"select * from ({sql.pairs(f'({sql.words()})')}) order by cnt desc, l desc, r desc limit 1")
def top_pair(spark, sf_dir):
    return counting.top_pair(pair_counts(spark, sf_dir))


_INDEX = f"select distinct word, p[i] l, p[i + 1] r from (select word, p, unnest(range(1, len(p))) i from (select word, {sql.PARTS} p from ({sql.words()})))"


@query(f"select count(*) n_pairs, cast(coalesce(sum(n), 0) as bigint) n_entries, round(coalesce(avg(n), 0), 6) mean_words from (select l, r, count(*) n from ({_INDEX}) group by l, r)")
def pair_index_stats(spark, sf_dir):
    found = counting.index_totals(counting.pair_index(word_counts(spark, sf_dir)))
    return found.withColumn("mean_words", F.round("mean_words", 6))


@query(f"{sql.merge_chain(1)} select l, r, cast(sum(d) as bigint) delta from (select l, r, -cnt d from ({sql.pairs('w0')}) union all select l, r, cnt from ({sql.pairs('w1')})) group by l, r having sum(d) <> 0")
def pair_delta(spark, sf_dir):
    words = word_counts(spark, sf_dir)
    first = counting.top_pair(counting.pair_counts(words)).first()
    return counting.merge_deltas(words, first["l"], first["r"])


@query(f"{sql.merge_chain(1)} {sql.pairs('w1')}")
def pair_counts_after_merge(spark, sf_dir):
    words = word_counts(spark, sf_dir)
    pairs = counting.pair_counts(words)
    first = counting.top_pair(pairs).first()
    return counting.apply_deltas(pairs, counting.merge_deltas(words, first["l"], first["r"]))


@query(f"select distinct tok token from ({sql.tokens('benchmark', 'item_id')}) except select distinct tok from ({sql.tokens('documents', 'doc_id')})")
def words_only_in_benchmark(spark, sf_dir):
    of = lambda name: counting.token_counts(_table(spark, sf_dir, name)).select("token")
    return of("benchmark").subtract(of("documents"))


# Vocabulary


@query(f"{sql.merge_chain(K)} select cast(rank as int) rank, l, r, cnt from ({sql.merges(K)})")
def bpe_merges(spark, sf_dir):
    merges = train(_table(spark, sf_dir, "documents"), 257 + K, (END_OF_TEXT,))
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "rank int, l string, r string, cnt long")


@query(ORACLE["bpe_merges"])
def bpe_merges_in_rounds(spark, sf_dir):
    merges = train(_table(spark, sf_dir, "documents"), 257 + K, (END_OF_TEXT,), local_words=0)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "rank int, l string, r string, cnt long")


@query(f"{sql.merge_chain(K)} select token_id, token from ({sql.vocabulary(K, END_OF_TEXT)})")
def vocab_table(spark, sf_dir):
    return _vocabulary(spark, sf_dir).table(spark)


@query(f"{sql.merge_chain(K)} select token, max(token_id) token_id from ({sql.vocabulary(K, END_OF_TEXT)}) group by token")
def reverse_vocab(spark, sf_dir):
    return vocabulary.reverse_vocabulary(vocab_table(spark, sf_dir))


@query(f"{sql.merge_chain(K)} select cast(rank as int) rank, l || r token, cast(length(l || r) / 2 as int) n_bytes from ({sql.merges(K)}) order by n_bytes desc, rank limit 30")
def longest_merges(spark, sf_dir):
    return vocabulary.longest_merges(_vocabulary(spark, sf_dir).merge_table(spark))


@query(f"{sql.merge_chain(K)} select token_id, case when token_id between 129 and 256 then '<bytes: ' || lower(token) || '>' else decode(unhex(token)) end shown from ({sql.vocabulary(K, END_OF_TEXT)})")
def printable_vocab(spark, sf_dir):
    return vocab_table(spark, sf_dir).select("token_id", printable(F.col("token")).alias("shown"))


@query("""with b as (select cast(i as int) byte, i between 33 and 126 or i between 161 and 172 or i between 174 and 255 keeps from range(256) t(i))
select byte, cast(case when keeps then byte else 255 + sum(case when keeps then 0 else 1 end) over (order by byte) end as int) code from b""")
def byte_alphabet(spark, sf_dir):
    return printable_bytes(spark)


# Encoding

_ENCODED = f"""{sql.merge_chain(K)}, v as (select token, max(token_id) id from ({sql.vocabulary(K, END_OF_TEXT)}) group by token),
e as materialized (select orig, i, id from (select orig, p, unnest(range(1, len(p) + 1)) i from (select orig, {sql.PARTS} p from w{K})) x join v on v.token = x.p[i]),
n as materialized (select orig, count(*) n, string_agg(id, ' ' order by i) ids, sum(id) total from e group by orig)"""
_TOKENS = f"(select *, {sql.WORD} word from ({sql.tokens('documents', 'doc_id')}))"


@query(f"{_ENCODED} select orig word, ids from n")
def encode_words(spark, sf_dir):
    words = counting.token_counts(_table(spark, sf_dir, "documents")).select("token")
    coded = encoding.encode(words, _vocabulary(spark, sf_dir), "token")
    return coded.select(as_word(F.col("token")).alias("word"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"{_ENCODED} select orig word, ids from n")
def encode_words_folded(spark, sf_dir):
    words = counting.token_counts(_table(spark, sf_dir, "documents")).select("token")
    coded = encoding.encode_distinct(words, _vocabulary(spark, sf_dir))
    return coded.select(as_word(F.col("token")).alias("word"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"{_ENCODED} select doc_id, cast(sum(n) as bigint) n_tokens, cast(sum(total) as bigint) id_total from {_TOKENS} t join n on n.orig = t.word group by doc_id")
def tokens_per_doc(spark, sf_dir):
    coded = encoding.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary(spark, sf_dir))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return coded.where(F.size("ids") > 0).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), total.alias("id_total"))


@query(f"{_ENCODED} select round(sum(octet_length(encode(d.text))) / (select sum(n) from {_TOKENS} t join n on n.orig = t.word), 6) bytes_per_token from documents d")
def compression_ratio(spark, sf_dir):
    coded = encoding.encode(_table(spark, sf_dir, "documents").select("text"), _vocabulary(spark, sf_dir))
    return coded.agg(F.round(F.sum(F.octet_length("text")) / F.sum(F.size("ids")), 6).alias("bytes_per_token"))


@query("select doc_id, sha256(text) digest from documents")
def decode_text(spark, sf_dir):
    v = _vocabulary(spark, sf_dir)
    out = encoding.decode(encoding.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), v), v)
    return out.select("doc_id", F.sha2("decoded", 256).alias("digest"))


@query("select count(*) n from documents")
def roundtrip_ok(spark, sf_dir):
    return encoding.round_trips(_table(spark, sf_dir, "documents").select("text"), _vocabulary(spark, sf_dir)).where("ok").agg(F.count("*").alias("n"))


_JOINED = f"(select conv_id, string_agg(text, {sql.quoted(END_OF_TEXT)} order by turn) text from conversations group by conv_id)"


def _joined(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), END_OF_TEXT).alias("text"))


@query(f"select conv_id, i pos, p[i] part from (select conv_id, p, unnest(range(1, len(p) + 1)) i from (select conv_id, string_split(text, {sql.quoted(END_OF_TEXT)}) p from {_JOINED}))")
def special_split(spark, sf_dir):
    parts = _joined(spark, sf_dir).select("conv_id", F.posexplode(segments(F.col("text"), (END_OF_TEXT,))).alias("pos", "part"))
    return parts.withColumn("pos", (F.col("pos") + 1).cast("long"))


@query(f"select conv_id, cast(2 * count(*) - 1 as bigint) n_pieces, cast(count(*) - 1 as bigint) n_special from conversations group by conv_id")
def special_pieces(spark, sf_dir):
    kept = _joined(spark, sf_dir).select("conv_id", pieces(F.col("text"), (END_OF_TEXT,)).alias("p"))
    return kept.select("conv_id", F.size("p").cast("long").alias("n_pieces"), F.size(F.filter("p", lambda x: x == END_OF_TEXT)).cast("long").alias("n_special"))


@query("select cast(sum(n) as bigint) n from (select count(*) - 1 n from conversations group by conv_id)")
def special_token_total(spark, sf_dir):
    return encoding.token_total(encoding.encode(_joined(spark, sf_dir), _vocabulary(spark, sf_dir)), 0)


@query("""select doc_id, cast(length(text) - length(replace(text, chr(10), '')) + case when right(text, 1) = chr(10) or text = '' then 0 else 1 end as bigint) n_chunks from documents where text <> ''""")
def encode_chunks(spark, sf_dir):
    coded = encoding.encode_chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary(spark, sf_dir))
    return coded.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


# Training examples

_ORDERS = "(select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) ids from lineitem group by l_orderkey)"
_WINDOWS = f"select l_orderkey, cast(s as int) start, ids[s + 1:s + 3] x, ids[s + 2:s + 4] y from (select l_orderkey, ids, unnest(range(0, len(ids) - 3)) s from {_ORDERS} where len(ids) > 3)"


def _sequences(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    return items.select("l_orderkey", F.transform("r", lambda x: x["l_partkey"]).alias("ids"))


@query(f"select l_orderkey, start, array_to_string(x, ' ') x, array_to_string(y, ' ') y from ({_WINDOWS})")
def lm_windows(spark, sf_dir):
    out = windows.lm_windows(_sequences(spark, sf_dir), 3, 1)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("l_orderkey", "start", text("x"), text("y"))


@query(f"""with c as (select start, count(*) n from ({_WINDOWS}) group by start), t as (select sum(n) total, count(*) k from c)
select start, n, round(total / k - 5 * sqrt(total / k * (1 - 1.0 / k)), 4) low, round(total / k + 5 * sqrt(total / k * (1 - 1.0 / k)), 4) high from c, t""")
def start_histogram(spark, sf_dir):
    out = windows.start_histogram(windows.lm_windows(_sequences(spark, sf_dir), 3, 1))
    return out.select("start", "n", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query()
def random_batch(spark, sf_dir):
    coded = encoding.encode(_table(spark, sf_dir, "benchmark").select("item_id", "text"), _vocabulary(spark, sf_dir))
    return windows.random_batch(windows.dataset(coded, "item_id"), 32, 7, seed=1)


@query("""select i it, round(case when i < 7 then i / 7.0 when i > 21 then 0.1 else 0.1 + 0.5 * (1 + cos(pi() * (i - 7) / 14)) * 0.9 end, 9) lr from range(25) t(i)""")
def lr_schedule(spark, sf_dir):
    return spark.range(25).select(F.col("id").alias("it"), F.round(numeric.cosine_lr(F.col("id"), 1.0, 0.1, 7, 21), 9).alias("lr"))


# Numerics on embeddings


def _vectors(spark, sf_dir, n: int | None = None):
    v = F.col("embedding").cast("array<double>")
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", (v if n is None else F.slice(v, 1, n)).alias("v"))


def _long(df: DataFrame, *keys: str, column: str = "v") -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("i", "x")).select(*keys, "i", (F.round("x", 6) + 0.0).alias("x"))


_E = "(select vec_id, label, list_transform(embedding, lambda e: e::double) v from embeddings)"
_EI = f"(select vec_id, label, v, unnest(range(1, len(v) + 1)) j from {_E})"


@query(f"select vec_id, cast(j - 1 as int) i, round(exp(v[j] - list_max(v)) / list_sum(list_transform(v, lambda e: exp(e - list_max(v)))), 6) + 0.0 x from {_EI}")
def softmax(spark, sf_dir):
    return _long(_vectors(spark, sf_dir).withColumn("v", numeric.softmax(F.col("v"))), "vec_id")


@query(f"select round(avg(1000 * list_max(v) + ln(list_sum(list_transform(v, lambda e: exp(1000 * (e - list_max(v)))))) - 1000 * v[(label % 64) + 1]), 4) loss from {_E}")
def cross_entropy(spark, sf_dir):
    scaled = _vectors(spark, sf_dir).withColumn("v", F.transform("v", lambda e: e * 1000))
    return scaled.agg(F.round(F.avg(numeric.cross_entropy(F.col("v"), F.col("label") % 64)), 4).alias("loss"))


@query(f"select vec_id, cast(j - 1 as int) i, round(v[j] / sqrt(list_sum(list_transform(v, lambda e: e * e)) / len(v) + 1e-5), 6) + 0.0 x from {_EI}")
def rmsnorm(spark, sf_dir):
    return _long(_vectors(spark, sf_dir).withColumn("v", numeric.rms_norm(F.col("v"))), "vec_id")


@query(f"select vec_id, cast(j - 1 as int) i, round(v[j] / (1 + exp(-v[j])), 6) + 0.0 x from {_EI}")
def silu(spark, sf_dir):
    return _long(_vectors(spark, sf_dir).withColumn("v", numeric.silu(F.col("v"))), "vec_id")


_W = [[0.5, -1.0, 0.25, 2.0], [1.5, 0.0, -0.75, 1.0], [0.1, 0.2, 0.3, 0.4]]


@query(" union all ".join(f"select vec_id, {i} i, round({' + '.join(f'({w}) * v[{j + 1}]' for j, w in enumerate(row))}, 6) + 0.0 x from {_E}" for i, row in enumerate(_W)))
def linear(spark, sf_dir):
    return _long(_vectors(spark, sf_dir, 4).withColumn("v", numeric.linear(F.col("v"), numeric.matrix(_W))), "vec_id")


_LIN = [" + ".join(f"({w}) * v[{j + 1}]" for j, w in enumerate(row)) for row in _W]


@query(f"with h as (select vec_id, " + ", ".join(f"({a}) / (1 + exp(-({a}))) * ({b}) h{i}" for i, (a, b) in enumerate(zip(_LIN, _LIN[::-1]))) + f" from {_E}) select vec_id, i, round(x, 6) + 0.0 x from (select vec_id, 0 i, h0 - h1 + 0.5 * h2 x from h union all select vec_id, 1, 0.25 * h0 + 2 * h1 + h2 from h)")
def swiglu(spark, sf_dir):
    w2 = numeric.matrix([[1.0, -1.0, 0.5], [0.25, 2.0, 1.0]])
    return _long(_vectors(spark, sf_dir, 4).withColumn("v", numeric.swiglu(F.col("v"), numeric.matrix(_W), w2, numeric.matrix(_W[::-1]))), "vec_id")


@query(f"""select vec_id, cast(j - 1 as int) i, round(case when j % 2 = 1 then v[j] * cos(a) - v[j + 1] * sin(a) else v[j] * cos(a) + v[j - 1] * sin(a) end, 6) + 0.0 x
from (select *, (vec_id % 16) / pow(10000, 2 * ((j - 1) // 2) / 4.0) a from {_EI} where j <= 4)""")
def rope(spark, sf_dir):
    return _long(_vectors(spark, sf_dir, 4).withColumn("v", numeric.rope(F.col("v"), F.col("vec_id") % 16)), "vec_id")


@query(f"""with s as (select vec_id // 8 seq, vec_id % 8 pos, v[1:4] v from {_E}),
p as (select a.seq, a.pos, b.v, (a.v[1] * b.v[1] + a.v[2] * b.v[2] + a.v[3] * b.v[3] + a.v[4] * b.v[4]) / 2 s from s a join s b on a.seq = b.seq and b.pos <= a.pos),
e as (select seq, pos, v, exp(s - max(s) over (partition by seq, pos)) w from p)
select seq, pos, cast(j as int) i, round(sum(w * v[j + 1]) / sum(w), 6) + 0.0 x from (select *, unnest(range(4)) j from e) group by seq, pos, j""")
def attention(spark, sf_dir):
    v = _vectors(spark, sf_dir, 4)
    rows = v.select(F.floor(F.col("vec_id") / 8).alias("seq"), (F.col("vec_id") % 8).alias("pos"), F.col("v").alias("q"), F.col("v").alias("k"), "v")
    return _long(model.attention(rows, "seq", "pos"), "seq", "pos", column="out")


@query(f"select l_orderkey, l_linenumber, round(v[1], 6) + 0.0 x from lineitem join {_E} on vec_id = l_linenumber")
def embedding(spark, sf_dir):
    table = _vectors(spark, sf_dir).select(F.col("vec_id").alias("token_id"), F.col("v").alias("vector"))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("long").alias("token_id"))
    return model.gather(rows, table).select("l_orderkey", "l_linenumber", (F.round(F.col("vector")[0], 6) + 0.0).alias("x"))


@query(f"with n as (select sqrt(sum(case when vec_id % 10 <> 9 then v[2] * v[2] end)) n from {_E}) select vec_id, round(case when vec_id % 10 <> 9 then v[2] * case when n > 0.01 then 0.01 / (n + 1e-6) else 1 end end, 9) + 0.0 g from {_E}, n")
def grad_clip(spark, sf_dir):
    grad = F.when(F.col("vec_id") % 10 != 9, F.col("v")[1])
    params = _vectors(spark, sf_dir).select("vec_id", F.col("v")[0].alias("value"), grad.alias("grad"))
    return optimizing.clip_gradients(params, 0.01).select("vec_id", (F.round("grad", 9) + 0.0).alias("g"))


@query(f"""with s as (select vec_id, v[1] x, v[2] g from {_E}),
a as (select vec_id, g, 0.1 * g m, 0.001 * g * g s2, (x - 0.001 * sqrt(1 - 0.999) / (1 - 0.9) * (0.1 * g) / (sqrt(0.001 * g * g) + 1e-8)) * (1 - 0.00001) x from s),
b as (select vec_id, (x - 0.001 * sqrt(1 - 0.999 * 0.999) / (1 - 0.81) * (0.9 * m + 0.1 * g) / (sqrt(0.999 * s2 + 0.001 * g * g) + 1e-8)) * (1 - 0.00001) x from a)
select vec_id, round(x, 7) + 0.0 x from b""")
def adamw(spark, sf_dir):
    params = _vectors(spark, sf_dir).select("vec_id", F.col("v")[0].alias("value"), F.col("v")[1].alias("grad"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    for step in (1, 2):
        params = optimizing.adamw_step(params, step)
    return params.select("vec_id", (F.round("value", 7) + 0.0).alias("x"))


@query()
def transformer_logits(spark, sf_dir):
    config = model.Config(vocab_size=264, context_length=32, d_model=16, num_layers=2, num_heads=4, d_ff=32)
    v = _vocabulary(spark, sf_dir, 7)
    ids = encoding.encode(_table(spark, sf_dir, "benchmark").select("item_id", "text"), v)
    parts = windows.context_windows(ids, config.context_length)
    return model.next_token_logits(parts, config.random_weights(), config).select("item_id", "start", F.array_max("logits").alias("top"))


# Reports


@query("select event_id, case when s >= 3600 then (s // 3600) || ' hr ' || (s // 60 % 60) || ' min' else (s // 60) || ' min ' || (s % 60) || ' sec' end shown, format('{:,}', event_id * 1237) number from (select event_id, cast(floor(event_id * 3.7) as bigint) s from events)")
def formatted(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", formats.format_time(F.col("event_id") * 3.7).alias("shown"), formats.grouped_number(F.col("event_id") * 1237).alias("number"))


@query("""select user_id, event_id, round(speed, 6) speed, round(lag(speed) over (partition by user_id order by event_id), 6) previous_speed,
round(sum(value) over (partition by user_id order by event_id) / sum(s) over (partition by user_id order by event_id), 6) average_speed from (select *, (event_id % 7 + 1) * 3.14159::double s, value / ((event_id % 7 + 1) * 3.14159::double) speed from events)""")
def block_speeds(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "value", ((F.col("event_id") % 7 + 1) * 3.14159).alias("s"))
    out = windows.speeds(e, "user_id", "event_id", "value", "s")
    return out.select("user_id", "event_id", *(F.round(c, 6).alias(c) for c in ("speed", "previous_speed", "average_speed")))


@query("select event_type, round(sum(value), 4) spent, round(100 * sum(value) / sum(sum(value)) over (), 6) percent from events group by event_type")
def timing_breakdown(spark, sf_dir):
    out = windows.time_shares(_table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", F.round("seconds", 4).alias("spent"), F.round("percent", 6).alias("percent"))
