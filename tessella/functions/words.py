"""Words as strings of bracketed upper-case hex bytes, such as <61><62>.

Merging a pair is a literal replace of <L><R> by <LR>: brackets keep bytes aligned and replace runs
left to right without overlaps.  Upper-case hex orders like the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_word(token: Column) -> Column:
    """One element for each UTF-8 byte of a string."""
    return F.regexp_replace(F.hex(F.encode(token, "UTF-8")), "(..)", "<$1>")


def elements(word: Column) -> Column:
    """array<string> of hex elements."""
    return F.split(F.regexp_replace(word, "^<|>$", ""), "><")


def adjacent_pairs(word: Column) -> Column:
    """array<struct(l, r)> of all adjacent elements, overlapping ones included; empty below two."""

    def of(parts):
        many = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.struct(parts[i].alias("l"), parts[i + 1].alias("r")))
        return F.when(F.size(parts) > 1, many).otherwise(F.expr("cast(array() as array<struct<l:string,r:string>>)"))

    return F.transform(F.array(elements(word)), of)[0]


def merge_pair(word: Column, left: str, right: str) -> Column:
    return F.replace(word, F.lit(f"<{left}><{right}>"), F.lit(f"<{left}{right}>"))


def apply_merges(word: Column, merges: Iterable[tuple[str, str]]) -> Column:
    """All merges in rank order, one pass each."""
    pairs = [(f"<{a}><{b}>", f"<{a}{b}>") for a, b in merges]
    if not pairs:
        return word
    listed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    return F.aggregate(listed, word, lambda acc, m: F.replace(acc, m["a"], m["b"]))


def text_of(hexes: Column, errors: str = "replace") -> Column:
    """The string of an array of hex tokens.  errors: 'replace' puts U+FFFD for malformed bytes, 'strict' fails on them."""
    raw = F.unhex(F.array_join(hexes, "")).cast("string")
    if errors == "replace":
        return F.make_valid_utf8(raw)
    if errors == "strict":
        return F.validate_utf8(raw)
    raise ValueError("errors is 'replace' or 'strict' here; 'ignore' is decode_ignore")


def printable(token_hex: Column) -> Column:
    """A token as text where its bytes are UTF-8, else <bytes: hex>."""
    raw = F.unhex(token_hex).cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.concat(F.lit("<bytes: "), F.lower(token_hex), F.lit(">")))
