"""Encoding, decoding, special tokens, vocabularies."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from tessella.functions import words
from tessella.functions.pretokens import GPT2_PATTERN, pieces, pretokens, segments
from tessella.operators import encoding
from tessella.operators.vocabulary import Vocabulary, longest_merges, reverse_vocabulary
from tessella.sources.corpus import hex_of_printable, read_delimited, read_lines, read_merges, read_vocabulary
from tessella.sources.tables import Cache
from tessella.streaming.encoding import append_to, encode_stream, watch_folder, watch_lines

MERGES = (("61", "62"), ("6162", "63"), ("20", "6162"))
SPECIAL = ("<|endoftext|>", "<|endoftext|><|endoftext|>")
STRINGS = ["", "s", "\U0001f643", "Hello, how are you?", "Héllò hôw are ü? \U0001f643", "ab<|endoftext|><|endoftext|>abc<|endoftext|> ab", "abc abc\n\n\nabab \t x", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(STRINGS)), "i int, text string")


def test_round_trip(spark, texts):
    v = Vocabulary(MERGES, SPECIAL)
    assert encoding.round_trips(texts, v).where("not ok").count() == 0


def test_overlapping_specials(spark, texts):
    v = Vocabulary(MERGES, SPECIAL)
    ids = {r["i"]: r["ids"] for r in encoding.encode(texts, v).collect()}
    assert ids[5].count(1) == 1 and ids[5].count(0) == 1
    assert ids[7] is None and ids[0] == []


def test_pieces_and_segments(texts):
    kept = {r["i"]: r["p"] for r in texts.select("i", pieces(F.col("text"), SPECIAL).alias("p")).collect()}
    assert kept[5] == ["ab", SPECIAL[1], "abc", SPECIAL[0], " ab"]
    cut = {r["i"]: r["p"] for r in texts.select("i", segments(F.col("text"), SPECIAL).alias("p")).collect()}
    assert cut[5] == ["ab", "abc", " ab"]
    assert texts.select(segments(F.col("text"), ()).alias("p")).where("i = 1").first()["p"] == ["s"]


def test_pretokens_equal_python(spark):
    import regex

    odd = ["a  b", "x  \n", "it's we'LL", " 12² ٠", "　　a", "end   ", "!!\n\n", "a b"]
    df = spark.createDataFrame([(t,) for t in odd], "text string").select("text", pretokens(F.col("text")).alias("p"))
    for r in df.collect():
        assert r["p"] == regex.findall(GPT2_PATTERN, r["text"])


def test_folded_and_ranked_agree(spark):
    v = Vocabulary((*MERGES, ("61", "61"), ("6161", "61"), ("61", "6161")))
    tokens = spark.createDataFrame([(t,) for t in ("abc", "aaaa", "aaaaa", "xabcab", "aaab")], "token string")
    a = {r["token"]: r["ids"] for r in encoding.encode_distinct(tokens, v).collect()}
    b = {r["token"]: r["ids"] for r in encoding.encode(tokens, v, "token").collect()}
    assert a == b


def test_against_public_vocabulary(spark):
    folder = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
    if not os.path.exists(f"{folder}/byte_bpe_50k.json"):
        pytest.skip("no tokenizer files")
    import tiktoken

    model = json.load(open(f"{folder}/byte_bpe_50k.json"))["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = tuple((t.encode().hex().upper() if t == SPECIAL[0] else hex_of_printable(t), i) for t, i in model["vocab"].items())
    v = Vocabulary(tuple((hex_of_printable(a), hex_of_printable(b)) for a, b in pairs), (), ids)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{folder}/byte_bpe_50k.tiktoken", "rb"))}
    other = tiktoken.Encoding("own", pat_str=GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = encoding.Encoder(v)
    for t in [*STRINGS[:-1], "Die Übung, fünf­zig!", "def f(x):\n    return x**2\n"]:
        assert mine.encode(t) == other.encode_ordinary(t)
    assert list(mine.encode_iterable(["Hello\n", "you"])) == other.encode_ordinary("Hello\n") + other.encode_ordinary("you")


def test_decode_errors(spark):
    v = Vocabulary(())
    bad = [0xE2, 0x82, 0x41, 0xFF]
    df = spark.createDataFrame([(bad,)], "ids array<int>")
    for how in ("replace", "ignore"):
        assert encoding.decode(df, v, how).first()["decoded"] == bytes(bad).decode(errors=how)
    with pytest.raises(Exception):
        encoding.decode(df, v, "strict").collect()
    with pytest.raises(Exception):
        encoding.decode(spark.createDataFrame([([999],)], "ids array<int>"), v).collect()
    hexes = spark.createDataFrame([([f"{b:02X}" for b in bad],)], "h array<string>")
    assert hexes.select(words.text_of(F.col("h")).alias("t")).first()["t"] == bytes(bad).decode(errors="replace")


def test_chunks_keep_newlines(spark):
    df = spark.createDataFrame([(0, "a\n\nb"), (1, "a\n"), (2, "")], "i int, text string")
    got = encoding.encode_chunks(df, Vocabulary(())).orderBy("i", "chunk").collect()
    assert [(r["i"], r["chunk_text"]) for r in got] == [(0, "a\n"), (0, "\n"), (0, "b"), (1, "a\n")]


def test_vocabulary(spark, tmp_path):
    v = Vocabulary((("61", "6161"), ("6161", "61")), ("<s>",))
    assert v.token_of()[0] == "3C733E" and v.token_of()[1] == "00" and v.token_of()[257] == "616161"
    assert v.id_of()["616161"] == 258
    back = {r["token"]: r["token_id"] for r in reverse_vocabulary(v.table(spark)).collect()}
    assert back == v.id_of()
    assert [r["rank"] for r in longest_merges(v.merge_table(spark), 1).collect()] == [0]
    cache = Cache(spark, str(tmp_path))
    assert Vocabulary.load(cache, size=5) is None
    v.save(cache, size=5)
    assert Vocabulary.load(cache, size=5).id_of() == v.id_of()


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Ġ t\nh e\nnot a merge line\n\n", encoding="utf8")
    assert read_merges(spark, str(tmp_path / "m.txt")) == [("20", "74"), ("68", "65")]
    (tmp_path / "v.json").write_text(json.dumps({"!": 0, "Ġt": 1}), encoding="utf8")
    got = {r["token"]: r["token_id"] for r in read_vocabulary(spark, str(tmp_path / "v.json"), ("<s>", "!")).collect()}
    assert got == {"21": 0, "2074": 1, "3C733E": 2}


def test_corpus_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("one\n<|endoftext|>two\r\n<|endoftext|>", encoding="utf8")
    assert [r["text"] for r in read_delimited(spark, str(tmp_path / "c.txt")).collect()] == ["one\n", "two\r\n"]
    (tmp_path / "l.txt").write_bytes(b"a\r\nb\n\n")
    assert [r["text"] for r in read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a\r\n", "b\n", "\n"]


def test_stream_equals_batch(spark, texts, tmp_path):
    v = Vocabulary(MERGES, SPECIAL)
    texts.write.parquet(str(tmp_path / "in"))
    stream = encode_stream(watch_folder(spark, str(tmp_path / "in"), "i int, text string"), v)
    append_to(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["i"]: r["ids"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["i"]: r["ids"] for r in encoding.encode(texts, v).collect()}


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ab\n\nabc\n", encoding="utf8")
    v = Vocabulary(MERGES)
    append_to(encode_stream(watch_lines(spark, str(tmp_path / "in")), v), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = [r["ids"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted([encoding.Encoder(v).encode(t) for t in ("ab\n", "\n", "abc\n")])
