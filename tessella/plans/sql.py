"""DuckDB text shared by the oracles of the text queries."""

from __future__ import annotations

#: White space as Unicode has it; RE2's own class is ASCII's.
WS = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: RE2 has no lookahead: a mark before the last white space ahead of a word stands in for it.
TOKEN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(source: str, key: str, column: str = "text") -> str:
    """select key, tok: one row a pre-token."""
    marked = f"regexp_replace({column}, '([{WS}])([^{WS}])', chr(1) || '\\1\\2', 'g')"
    return f"select {key}, unnest(regexp_extract_all(part, {quoted(TOKEN)})) tok from (select {key}, unnest(string_split({marked}, chr(1))) part from {source})"


WORD = "regexp_replace(hex(encode(tok)), '(..)', '<\\1>', 'g')"
PARTS = "string_split(substr(word, 2, length(word) - 2), '><')"


def words(source: str = "documents", key: str = "doc_id") -> str:
    return f"select {WORD} word, count(*) cnt from ({tokens(source, key)}) group by all"


def pairs(table: str) -> str:
    """select l, r, cnt from a table of word, cnt."""
    return f"select p[i] l, p[i + 1] r, cast(sum(cnt) as bigint) cnt from (select p, cnt, unnest(range(1, len(p))) i from (select {PARTS} p, cnt from {table})) group by all"


def merge_chain(k: int) -> str:
    """CTEs m1..mk (l, r, cnt) and w0..wk (orig, word, cnt)."""
    out = [f"w0 as materialized (select word orig, word, cnt from ({words()}))"]
    for i in range(1, k + 1):
        out.append(f"m{i} as materialized (select l, r, cnt from ({pairs(f'w{i - 1}')}) order by cnt desc, l desc, r desc limit 1)")
        out.append(f"w{i} as materialized (select orig, replace(word, '<' || l || '><' || r || '>', '<' || l || r || '>') word, w{i - 1}.cnt from w{i - 1}, m{i})")
    return "with " + ", ".join(out)


def merges(k: int) -> str:
    return " union all ".join(f"select {i - 1} rank, l, r, cnt from m{i}" for i in range(1, k + 1))


def vocabulary(k: int, special: str) -> str:
    """select token_id, token."""
    return (
        f"select 0 token_id, hex(encode({quoted(special)})) token union all select cast(i + 1 as int), printf('%02X', i) from range(256) t(i) "
        f"union all select cast(rank + 257 as int), l || r from ({merges(k)})"
    )
