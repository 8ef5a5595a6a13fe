"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of template tokens: lower-case words, with typed
placeholders for numbers, units after numbers, and names.  A name is a capitalised word within a
sentence, and anywhere, at the start of a sentence or in capitals, a capitalised word that the benchmark
never writes in lower case; neighbouring names are one.  Windows of eight template tokens are hash-joined;
only windows of nearly nothing but placeholders are left out.  Hits of a text and an item on one diagonal
are an alignment, and so are those of a chain of diagonals, each at most the item's length from the next:
words put in, left out or replaced by more or fewer move what follows to another diagonal.  An alignment
is a leak when it covers a third of the item's windows and some plain words, and when its slots are
consistent: a value of the item always stands for the same value in the text, and no two of them for one.

Only DataFrame functions are used.  Windows of the corpus are never shuffled while the
benchmark's windows, counted first, are few enough to broadcast; beyond that the join is a
shuffle.  Verdicts depend on the text alone, so they are made once for each distinct text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle

WINDOW, COVER = 8, 1 / 3
#: An alignment covers so many plain words of the item, or half of the item's length where that is less.
PLAIN_WORDS = 4
#: Benchmark windows or slot candidates up to this many rows (about 50 MB) are broadcast.
BROADCAST_ROWS = 1_000_000
#: The benchmark's lower-case words, all of them, are told from names where they are capitalised.  They are looked up in
#: lists by hash, of so many words on average.
ORDINARY_LIST = 16
NUMBER, UNIT, NAME = "\ue001", "\ue002", "\ue003"
#: Units that count as such after a number.
UNITS = "km kg cm mm mg ml lb lbs oz ft kb mb gb tb hz mph kmh m g l s h meter meters metre metres mile miles gram grams kilogram kilograms kilometer kilometers kilometre kilometres liter liters litre litres pound pounds ounce ounces foot feet inches inch yard yards second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split()
#: The start of a capitalised word within a sentence; it gets a mark.
INNER_CAPITAL = r"\p{Lu}(?<=[\p{Ll},;]\x20\p{Lu})(?=\p{Ll})"
TOKEN = rf"[0-9]++(?:[.,:/][0-9]++)*+|{NAME}?[\p{{L}}\p{{M}}\p{{N}}&&[^0-9]]++"
LOWER_WORD = r"(?<![\p{L}\p{M}\p{N}])\p{Ll}[\p{Ll}\p{M}]*(?![\p{L}\p{N}])"
AFTER_DIGITS = ":"


def raw_tokens(text: Column) -> Column:
    """Numbers and words as they stand; capitalised words within a sentence are marked."""
    return F.regexp_extract_all(F.regexp_replace(text, INNER_CAPITAL, f"{NAME}$0"), F.lit(TOKEN), F.lit(0))


def _kinds(raw: Column, ordinary: Column | None, numbers: Column) -> Column:
    """A template token for each raw one; ``numbers`` says whether there are any."""

    def plain(t):
        low = F.lower(t)
        capital = low != t
        if ordinary is not None:
            capital = capital & ~F.contains(F.get(ordinary, _list_of(low, F.size(ordinary))), F.concat(F.lit(" "), low, F.lit(" ")))
        # most tokens begin with a small letter and are no more than lowered
        return F.when(t.between("a", "{"), low).when(F.startswith(t, F.lit(NAME)) | capital, NAME).otherwise(low)

    def kind(t, i):
        unit = F.coalesce(F.get(raw, i - 1) < AFTER_DIGITS, F.lit(False)) & F.lower(t).isin(UNITS)
        return F.when(t < AFTER_DIGITS, NUMBER).when(unit, UNIT).otherwise(plain(t))  # tokens begin with a digit, a letter or the mark

    return F.when(numbers, F.transform(raw, kind)).otherwise(F.transform(raw, plain))


def has_numbers(text: Column) -> Column:
    return text.rlike("[0-9]")


def _later_name(kinds: Column, i: Column) -> Column:
    return (F.get(kinds, i) == NAME) & F.get(kinds, i - 1).eqNullSafe(F.lit(NAME))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def template(text: Column, ordinary: Column | None = None) -> Column:
    """The template tokens of a text."""
    joined = lambda kinds: F.filter(kinds, lambda t, i: (t != NAME) | ~F.get(kinds, i - 1).eqNullSafe(F.lit(NAME)))
    of = lambda ordinary: _bound(raw_tokens(text), lambda raw: _bound(_kinds(raw, ordinary, has_numbers(text)), joined))
    return of(None) if ordinary is None else _bound(ordinary, of)


def slots(text: Column, ordinary: Column | None = None) -> Column:
    """struct(kind, value) of each template token; value, the raw one in lower case, is null where no placeholder stands."""

    def of(raw, kinds):
        n = F.size(kinds)
        at = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.coalesce(_later_name(kinds, i), F.lit(False)))

        def slot(at, i, j):
            words = F.slice(raw, i + 1, F.get(at, j + 1) - i)  # up to the next template token
            value = F.translate(F.lower(F.array_join(words, " ")), NAME, "")
            return F.struct(F.get(kinds, i).alias("kind"), F.when(F.get(kinds, i).isin(NUMBER, UNIT, NAME), value).alias("value"))

        return _bound(at, lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda i, j: slot(at, i, j)))

    none = F.expr("cast(array() as array<struct<kind:string,value:string>>)")
    whole = lambda ordinary: _bound(raw_tokens(text), lambda raw: _bound(_kinds(raw, ordinary, has_numbers(text)), lambda kinds: F.when(F.size(kinds) > 0, of(raw, kinds)).otherwise(none)))
    return whole(None) if ordinary is None else _bound(ordinary, whole)


def _list_of(word: Column, lists: Column) -> Column:
    return F.pmod(F.xxhash64(word), lists).cast("int")


def ordinary_words(items: DataFrame) -> Column:
    """All words that the benchmark writes in lower case: an array of lists by hash.  It is the value of a subquery, so
    plans don't hold the words; ``template`` and ``slots`` take it as a column of their table."""
    words = items.select(F.explode(F.regexp_extract_all("text", F.lit(LOWER_WORD), F.lit(0))).alias("word"))
    words = settle(words.distinct(), "ordinary-words")
    lists = max(1, words.count() // ORDINARY_LIST)
    filled = words.groupBy(_list_of(F.col("word"), F.lit(lists)).alias("at")).agg(F.concat(F.lit(" "), F.array_join(F.collect_list("word"), " "), F.lit(" ")).alias("list"))
    every = words.sparkSession.range(lists).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("list", F.lit(" ")).alias("list")))).alias("lists"))
    return settle(row.select(F.col("lists.list").alias("lists")), "ordinary-lists").select("lists").scalar()


def window_hashes(tokens: Column, width: int = WINDOW) -> Column:
    """A hash of every window; a shorter sequence is one window of its own."""

    def of(w):
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
        return F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(n, w))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return _bound(F.transform(tokens, lambda t: F.xxhash64(t)), of)


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for the text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def text_windows(texts: DataFrame, ordinary: Column | None, width: int = WINDOW) -> DataFrame:
    """k1, k2, low (whether the text has no capitals), pos, h: a row a window of each of ``texts``; a text without windows has one row, of nulls."""
    # the keys are worked out before the windows become rows, once a text; an outer generator keeps Spark from adding
    # a filter for texts without windows, below, that works out the windows twice more
    table = texts if ordinary is None else texts.withColumn("ordinary", ordinary)
    tokens = template(F.col("text"), None if ordinary is None else F.col("ordinary"))
    cut = table.select(*text_keys(F.col("text")), (F.lower("text") == F.col("text")).alias("low"), window_hashes(tokens, width).alias("hashes"))
    return cut.select("k1", "k2", "low", F.posexplode_outer("hashes").alias("pos", "h"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, cover: float = COVER) -> DataFrame:
    """k1, k2 (the text's keys), item_id, n_windows, item_windows, exact: one row for each text and item it leaks.

    ``exact`` says that no slot of the alignment was changed.  Defined results: null or empty texts
    and items match nothing; repeated items are one item; an item shorter than a window leaks where
    a text's whole template equals its own; an item of nearly nothing but placeholders leaks nowhere; empty
    tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min(F.col("text").cast("string")).alias("text"))
    ordinary = ordinary_words(items)
    # an item stands as it is written and, for texts that have no capitals, all in lower case
    forms = F.array_distinct(F.array("text", F.lower("text")))
    parsed = items.select("item_id", F.posexplode(forms).alias("form", "text")).withColumn("ordinary", ordinary)
    parsed = parsed.select("item_id", "form", "text", template(F.col("text"), F.col("ordinary")).alias("tokens"))
    parsed = settle(parsed, "benchmark-templates")
    said = parsed.select("item_id", "form", "tokens", F.posexplode(window_hashes(F.col("tokens"), width)).alias("ipos", "h"))
    plain_words = F.filter(F.slice("tokens", F.col("ipos") + 1, width), lambda t: ~t.isin(NUMBER, UNIT, NAME))
    said = said.where(4 * F.size(plain_words) >= F.least(F.lit(width), F.size("tokens"))).select("item_id", "form", "ipos", "h", F.size("tokens").alias("item_tokens"))
    counts = said.groupBy("item_id", "form").agg(F.count("*").cast("int").alias("item_windows"))
    windows = settle(said.join(counts, ["item_id", "form"]), "benchmark-windows")
    if windows.count() <= BROADCAST_ROWS:
        windows = F.broadcast(windows)
    texts = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    seen = text_windows(texts, ordinary, width)
    hits = seen.join(windows, "h").where((F.col("form") == 0) | F.col("low"))
    # copies of a text count once: positions, not rows
    key = ["k1", "k2", "item_id", "form", "item_windows", "item_tokens"]
    lines = hits.groupBy(*key, (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("at"))
    order = Window.partitionBy(*key).orderBy("shift")
    far = F.coalesce(F.col("shift") - F.lag("shift").over(order) > F.col("item_tokens"), F.lit(False)).cast("int")
    chained = lines.withColumn("far", far).withColumn("chain", F.sum("far").over(order)).groupBy(*key, "chain").agg(F.array_sort(F.collect_list(F.struct((-F.size("at")).alias("n"), "shift", "at"))).alias("lines"))
    # each window of the item counts on the diagonal, of those that have it, with the most windows
    step = lambda acc, x: F.struct(F.array_union(acc["seen"], x["at"]).alias("seen"), F.concat(acc["parts"], F.array(F.struct(x["shift"].alias("shift"), F.array_except(x["at"], acc["seen"]).alias("at")))).alias("parts"))
    none = F.struct(F.expr("cast(array() as array<int>)").alias("seen"), F.expr("cast(array() as array<struct<shift:int,at:array<int>>>)").alias("parts"))
    joined = F.filter(F.aggregate("lines", none, step, lambda acc: acc["parts"]), lambda x: F.size(x["at"]) > 0)
    alone = F.transform("lines", lambda x: F.array(F.struct(x["shift"].alias("shift"), x["at"].alias("at"))))
    aligned = chained.select(*key, F.explode(F.array_distinct(F.concat(F.array(joined), alone))).alias("parts"))
    aligned = aligned.withColumn("n_windows", F.aggregate("parts", F.lit(0), lambda n, x: n + F.size(x["at"]))).where(F.col("n_windows") >= F.greatest(F.lit(1), F.ceil(F.col("item_windows") * cover)))
    aligned = settle(aligned, "alignments")
    has_slots = parsed.select(F.col("item_id").alias("s_item"), F.col("form").alias("s_form"), F.col("text").alias("s_text"), F.col("tokens").alias("s_tokens")).where(F.exists("tokens", lambda t: t.isin(NUMBER, UNIT, NAME)))
    same = (F.col("item_id") == F.col("s_item")) & (F.col("form") == F.col("s_form"))
    open_ = aligned.join(has_slots.select("s_item", "s_form"), same, "left_semi")
    plain = aligned.join(has_slots.select("s_item", "s_form"), same, "left_anti").withColumn("exact", F.lit(True))
    count = open_.count()
    if count:
        keys = open_.select("k1", "k2").distinct()
        keyed = texts.select(*text_keys(F.col("text")), "text").join(F.broadcast(keys) if count <= BROADCAST_ROWS else keys, ["k1", "k2"], "left_semi")
        one = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
        both = open_.join(one, ["k1", "k2"]).join(has_slots, same).withColumn("ordinary", ordinary)
        # written, so that slots are worked out once a text and not again for each diagonal
        both = settle(both.select(*aligned.columns, F.size("s_tokens").alias("n_said"), slots(F.col("s_text"), F.col("ordinary")).alias("said"), slots(F.col("text"), F.col("ordinary")).alias("here")), "slots")
        both = both.withColumn("covered", F.flatten(F.transform("parts", lambda x: x["at"])))

        def on_line(x):
            low = F.array_min(x["at"])
            length = F.array_max(x["at"]) - low + F.least(F.lit(width), F.col("n_said"))
            pairs = F.zip_with(F.slice("said", low + 1, length), F.slice("here", low + x["shift"] + 1, length), lambda b, d: F.struct(b["kind"].alias("kind"), b["value"].alias("was"), d["value"].alias("now")))
            return F.filter(pairs, lambda s, j: s["was"].isNotNull() & F.exists(x["at"], lambda i: (low + j).between(i, i + (width - 1))))

        plain_said = F.filter("said", lambda s, j: s["value"].isNull() & F.exists("covered", lambda i: j.between(i, i + (width - 1))))
        both = both.withColumn("n_plain", F.size(plain_said)).withColumn("slots", F.array_distinct(F.flatten(F.transform("parts", on_line))))
        many = lambda name: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s[name]))))
        enough = F.col("n_plain") >= F.least(F.lit(PLAIN_WORDS), F.ceil(F.col("n_said") / 2))
        consistent = enough & (F.size("slots") == many("was")) & (F.size("slots") == many("now"))
        checked = both.where(consistent).withColumn("exact", F.forall("slots", lambda s: s["was"].eqNullSafe(s["now"])))
        plain = plain.unionByName(checked.select(*plain.columns))
    return plain.groupBy("k1", "k2", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("exact").alias("exact"))


def leaking_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, exact: a row for each document and benchmark item that it leaks."""
    leaks = settle(find_leaks(docs, benchmark), "leaks")
    mine = docs.select("doc_id", *text_keys(F.col("text").cast("string")))
    return mine.join(leaks, ["k1", "k2"]).select("doc_id", "item_id", "n_windows", "item_windows", "exact")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that leak no item.  Documents with a null text stay."""
    keys = settle(find_leaks(docs, benchmark).select(F.col("k1").alias("leak_k1_"), F.col("k2").alias("leak_k2_")).distinct(), "leaking-texts")
    k1, k2 = text_keys(F.col("text").cast("string"))
    small = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return docs.join(small, (k1 == F.col("leak_k1_")) & (k2 == F.col("leak_k2_")), "left_anti")


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    """op2: documents and the benchmark items that they leak."""
    return leaking_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: drop documents that leak a benchmark item."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
