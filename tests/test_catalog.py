"""Every query of the engine against its SQL on DuckDB, and the driver's contract."""

import glob
import os

import duckdb
import pytest

from tests.conftest import SMALL, rows_of
from tessella.plans import catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    assert rows_of(got) == rows_of(duck.execute(catalog.ORACLE[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dataset_has_all_sequences_in_order(spark):
    from tessella.operators import windows

    rows = [(2, [5, 6]), (0, [1, 2, 3]), (None, [9]), (None, [9]), (1, []), (2, [5, 6]), (3, None)]
    got = {r["pos"]: r["token_id"] for r in windows.dataset(spark.createDataFrame(rows, "item_id long, ids array<int>"), "item_id").collect()}
    assert [got[i] for i in range(len(got))] == [9, 9, 1, 2, 3, 5, 6, 5, 6]


def test_queries_reach_all_items(spark):
    n = spark.read.parquet(f"{SMALL}/benchmark.parquet").count()
    tops = catalog.QUERIES["transformer_logits"](spark, SMALL).collect()
    assert len({r["item_id"] for r in tops}) == n and len(tops) > n and all(r["top"] is not None for r in tops)
    first = max(r["start"] for r in catalog.QUERIES["random_batch"](spark, SMALL).collect())
    assert first > 500  # beyond any one item


def test_gpt5_words_against_regex(spark):
    from collections import Counter

    import regex

    from tessella.functions.pretokens import GPT5_PATTERN

    texts = [r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = Counter(t.encode().hex().upper() for x in texts for t in regex.findall(GPT5_PATTERN, x))
    got = {r["word"].replace("<", "").replace(">", ""): r["cnt"] for r in catalog.QUERIES["gpt5_word_counts"](spark, SMALL).collect()}
    assert got == dict(want)


def test_encoded_chunks_have_the_ids_of_their_lines(spark):
    from tessella.operators import encoding
    from tessella.operators.vocabulary import Vocabulary

    v = Vocabulary((("74", "68"), ("7468", "65"), ("20", "7468")), ("<|endoftext|>",))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    encoder, want = encoding.Encoder(v), []
    for r in docs.collect():
        lines = (r["text"] or "").split("\n")
        parts = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        want += [(r["doc_id"], i, p, list(encoder.encode_iterable([p]))) for i, p in enumerate(parts)]
    got = [(r["doc_id"], r["chunk"], r["chunk_text"], r["ids"]) for r in encoding.encode_chunks(docs, v).collect()]
    assert sorted(got) == sorted(want)
