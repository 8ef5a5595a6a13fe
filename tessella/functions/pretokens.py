"""Splitting texts at special tokens and into pre-tokens."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pre-tokenization patterns and the end-of-text token.
GPT2_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
GPT5_PATTERN = "|".join([
    r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?""",
    r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?""",
    r"""\p{N}{1,3}""",
    r""" ?[^\s\p{L}\p{N}]+[\r\n/]*""",
    r"""\s*[\r\n]+""",
    r"""\s+(?!\S)""",
    r"""\s+""",
])
END_OF_TEXT = "<|endoftext|>"


def alternation(special_tokens: Sequence[str]) -> str:
    """A Java expression that matches any special token, longer ones first."""
    return "|".join(rf"\Q{t}\E" for t in sorted(special_tokens, key=len, reverse=True))


def pretokens(text: Column, pattern: str = GPT2_PATTERN) -> Column:
    """array<string>; null stays null.  (?U) makes the classes Unicode's."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def segments(text: Column, special_tokens: Sequence[str]) -> Column:
    """The text between special tokens, which are dropped (for training).  Without special tokens, the text itself."""
    if not special_tokens:
        return F.array(text)
    return F.split(text, alternation(special_tokens), -1)


def pieces(text: Column, special_tokens: Sequence[str]) -> Column:
    """The text cut at special tokens, which are kept as pieces (for encoding); no piece is empty."""
    if not special_tokens:
        return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    either = alternation(special_tokens)
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:{either})|(?:(?!{either}).)+"), F.lit(0))


def python_alternation(special_tokens: Sequence[str]) -> re.Pattern | None:
    """The same alternation for Python code on the executors."""
    if not special_tokens:
        return None
    return re.compile("(" + "|".join(re.escape(t) for t in sorted(special_tokens, key=len, reverse=True)) + ")")
