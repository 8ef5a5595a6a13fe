"""Small fixtures with awkward rows, shared by the tests of this folder."""

import re
import string
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LINE = "the quick brown fox jumps over the lazy dog near the old river bank"
ROWS = [
    (1, LINE + "\n" + LINE.upper() + "\nother words stand here for a change today", "a"),
    (2, LINE + "\n" + LINE.upper() + "\nother words stand here for a change today", "a"),
    (2, LINE + "\n" + LINE.upper() + "\nother words stand here for a change today", "a"),
    (3, None, "b"),
    (4, "", "b"),
    (5, " \t\n\x0b ", None),
    (6, "one", "é"),
    (7, "One", None),
    (8, "two words", "a"),
    (None, "a text without an id, which nobody can call by name but all can read", "b"),
    (None, "a text without an id, which nobody can call by name but all can read", "b"),
    (9, "x" * 50_000, "b"),
    (10, " ".join(f"w{i % 977}" for i in range(30_000)), "a"),
    (11, "é😀 ü " * 30 + "\n\n\n", "c"),
    (12, "\x00\x01 nul and controls", "c"),
]
EXTRA = ("size", "target", "taken", "score", "n", "f1", "rid", "line", "word", "block", "cluster", "terms", "k1", "h", "kept", "weight", "cnt", "side")


def docs(spark, rows=ROWS, extra=True):
    """documents with awkward rows, and columns whose names operators might use themselves."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"'x' as {c}" for c in EXTRA)) if extra else df


def labels(spark, rows=((1, 1), (2, 1), (2, None), (6, 0), (None, 1), (9, 0), (10, 0), (8, 1), (4, 0))):
    return spark.createDataFrame([(i, q, 0, "x") for i, q in rows], "doc_id long, quality int, toxic int, text string")


def benchmark(spark, rows=((0, "no such item stands in any of the texts at all"), (None, "x"), (1, None), (2, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOW) if lower else text)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())
