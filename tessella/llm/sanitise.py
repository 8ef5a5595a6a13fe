"""Information-theoretic sanitisation of personal data.

Fixed patterns find the protected entities: e-mail and IP addresses, card and phone numbers.
Corpus co-occurrence then tells which terms near an entity give it away: for term t and entity e,
pointwise mutual information PMI(e; t) = log(p(e, t) / (p(e) p(t))) is the part of the entity's
information content IC(e) = -log p(e) that the term discloses.  From ``generalise`` times IC on
a term is generalised, from ``remove`` times on it is removed.  The context is the whole document,
and an entity of a single document counts like any other.

Only DataFrame functions are used.  Matching is one pass without a shuffle; spans are found by
splitting and extracting with the same expression, so offsets are sums of lengths.  Term
frequencies are summed before they are shuffled.  What is joined back are only the terms of
documents with entities, and of those only terms rare enough to disclose one at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the contract's expressions.  A match may start at the start of a run or where
# the last match ended (\G); starts inside a run can't match what its start couldn't.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
# Only runs of 13 digits and more match at all, from their start.
CARD = r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){12}[0-9])[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
TERM = r"\p{L}+"
#: Pieces that cut no term; their matches are placed by the piece's offset, which keeps long texts linear.
PIECE = r"(?s).{1,2000}(?!\p{L})|.\p{L}+"
NO_SPANS = "cast(array() as array<struct<s:int,e:int,m:string>>)"


#: Sums run within chunks of so many elements and over chunks, so that no array grows by one element at a time.
CHUNK = 256


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def placed(parts: Column, width) -> Column:
    """array<struct(at, x)>: each element with the sum of the widths before it, in time in proportion to their number."""

    def along(elements, start, size, name):
        none = F.slice(F.transform(elements, lambda x: F.struct(start.alias("at"), x.alias(name))), F.lit(1), F.lit(0))
        step = lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x.alias(name)))).alias("out"))
        return F.aggregate(elements, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def of(parts):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda c: F.slice(parts, c * CHUNK + 1, CHUNK))
        whole = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, x: n + width(x))
        many = F.flatten(F.transform(along(chunks, F.lit(0), whole, "c"), lambda y: along(y["c"], y["at"], width, "x")))
        return F.when(F.size(parts) <= CHUNK, along(parts, F.lit(0), width, "x")).otherwise(many)

    return _bound(parts, of)


def matches(text: Column, pattern: str) -> Column:
    """array<struct(s, e, m)>: start, end and text of all leftmost non-overlapping matches, in code points."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("g"), m.alias("m")))
    at = placed(parts, lambda x: x["g"] + F.coalesce(F.length(x["m"]), F.lit(0)))
    found = F.filter(at, lambda y: y["x"]["m"].isNotNull())
    return F.transform(found, lambda y: F.struct((y["at"] + y["x"]["g"]).alias("s"), (y["at"] + y["x"]["g"] + F.length(y["x"]["m"])).alias("e"), y["x"]["m"].alias("m")))


def _luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def entities(text: Column) -> dict[str, Column]:
    """The valid matches of each kind."""
    digit = text.rlike("[0-9]")
    none = F.expr(NO_SPANS)
    found = {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)),
        "ip": F.when(digit, F.filter(matches(text, IP), lambda x: x["m"].rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"))),
        "card": F.when(digit, F.filter(matches(text, CARD), lambda x: F.when(F.length(x["m"]) >= 13, _luhn(x["m"])).otherwise(False))),
        "phone": F.when(digit & F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda x: F.length(F.regexp_replace(x["m"], "[^0-9]", "")).between(9, 15))),
    }
    return {k: F.coalesce(c, none) for k, c in found.items()}


def _terms(text: Column) -> Column:
    """The terms of a text that no e-mail address overlaps (other entities have no letters): array<struct(s, e, term)>."""

    def of_piece(start, piece):
        return F.transform(matches(piece, TERM), lambda t: F.struct((t["s"] + start).alias("s"), (t["e"] + start).alias("e"), F.lower(t["m"]).alias("term")))

    def of_gap(start, gap):
        pieces = placed(F.regexp_extract_all(gap, F.lit(PIECE), F.lit(0)), lambda x: F.length(x))
        return F.flatten(F.transform(pieces, lambda y: of_piece(y["at"] + start, y["x"])))

    def of_gaps(parts):
        at = placed(parts, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0)))

        def inner(y, i):
            end = y["at"] + F.length(y["x"]["gap"])
            # what touches an address is a part of a term that goes on in it
            return F.filter(of_gap(y["at"], y["x"]["gap"]), lambda t: ((t["s"] > y["at"]) | (i == 0)) & ((t["e"] < end) | y["x"]["m"].isNull()))

        return F.flatten(F.transform(at, inner))

    gaps = F.zip_with(F.split(text, EMAIL, -1), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    return F.when(F.contains(text, F.lit("@")), _bound(gaps, of_gaps)).otherwise(of_gap(F.lit(0), text))


def find_entities(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Written table: rid, doc_id, email, ip, card, phone (spans), near (array of struct(s, e, term): all terms,
    in documents with an entity)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text)
    found = base.select("rid", "doc_id", "text", *(c.alias(k) for k, c in entities(F.col("text")).items()))
    every = F.concat(*(F.col(k) for k in KINDS))
    table = found.withColumn("near", F.when(F.size(every) > 0, _terms(F.col("text"))))
    return settle(table if keep_text else table.drop("text"), "entities")


def disclosures(docs: DataFrame, found: DataFrame, generalise: float) -> DataFrame:
    """rid, term, share: the most that a term discloses of an entity in its document, from ``generalise`` on."""
    total = float(found.count())
    held = found.where(F.size("near") > 0)
    mine = held.select("rid", F.explode(F.array_distinct(F.transform(F.concat(*KINDS), lambda x: F.lower(x["m"])))).alias("entity"))
    known = mine.join(mine.groupBy("entity").agg(F.count("*").alias("n_entity")), "entity")
    # all entities that only one document has get the same shares there, so one stands for them
    single = known.where("n_entity = 1").groupBy("rid").agg(F.min("entity").alias("entity"), F.min("n_entity").alias("n_entity"))
    known = known.where("n_entity > 1").select("rid", "entity", "n_entity").unionAll(single)
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col("text").cast("string"), F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))
    by_term = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    said = held.select("rid", F.explode(F.array_distinct(F.transform("near", lambda x: x["term"]))).alias("term")).join(by_term, "term")
    information = F.log2(F.lit(total) / F.col("n_entity"))
    # both together are in no more documents than either: a term too frequent for the threshold makes no pair
    most = F.log2(F.lit(total) / F.greatest("n_entity", "n_term"))
    pairs = settle(said.join(known, "rid").where((information > 0) & (most >= generalise * information - 1e-9)), "term-pairs")
    pmi = F.log2(F.col("n_both") * F.lit(total) / (F.col("n_entity") * F.col("n_term")))
    told = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both")).select("entity", "term", (pmi / information).alias("share"))
    return pairs.join(told.where(F.col("share") >= generalise), ["entity", "term"]).groupBy("rid", "term").agg(F.max("share").alias("share"))


def find_private(docs: DataFrame, generalise: float = 0.7, remove: float = 0.9, keep_text: bool = False) -> DataFrame:
    """rid, doc_id, email, ip, card, phone, terms (array of struct(s, e, action)), and text if asked for.

    Terms of an entity's document that disclose it are terms; those that overlap an
    entity are left to it.  Defined results: null text is empty and has no spans; a null doc_id is a
    document like others; equal rows get equal rows; an empty table gives no rows; columns other than
    doc_id and text are ignored.
    """
    found = find_entities(docs, keep_text)
    told = settle(disclosures(docs, found, generalise), "disclosures")
    near = found.where(F.size("near") > 0).select("rid", F.explode("near").alias("n")).select("rid", "n.*")
    marked = near.join(told, ["rid", "term"])
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    terms = marked.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s", "e", action.alias("action")))).alias("terms"))
    out = found.drop("near").join(terms, "rid", "left")
    return out.withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<s:int,e:int,action:string>>)")))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = F.concat(*(_listed(k, F.col(k)) for k in KINDS))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, _listed("term", F.col("terms"))), ",").alias("spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text with entities replaced by their kind, generalised terms by <TERM>, removed terms by nothing."""
    found = find_private(docs, keep_text=True, **options)
    label = lambda spans, value: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), value(x).alias("v")))
    marks = F.array_sort(F.concat(*(label(F.col(k), lambda x, k=k: F.lit(f"<{k.upper()}>")) for k in KINDS), label(F.col("terms"), lambda x: F.when(x["action"] == "remove", "").otherwise("<TERM>"))))
    step = lambda acc, x: F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), x["v"]).alias("out")))
    whole = F.aggregate(marks, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.select("doc_id", whole.alias("text"))


def sanitise_query(spark, sf_dir: str) -> DataFrame:
    """op10: base counts and digest, and all spans with the disclosing terms, of every document."""
    return report(find_private(spark.read.parquet(f"{sf_dir}/documents.parquet")))
