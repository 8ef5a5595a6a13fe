"""Secret scan: fixed patterns, and strings that dictionary-primed zstandard finds novel.

A candidate is a long string of letters and digits in a sensitive context.  Its novelty is
the number of compressed bytes that it adds to its surroundings, with a dictionary of
identifiers loaded into the compressor: what the dictionary or the surrounding
code explains adds next to nothing, a random key adds nearly its length.

The dictionary is learned: the names of letters and underscores that the most documents have.  A secret
has digits too, so copies of one in any number of documents don't get it into the dictionary.

Scale: one pass counts names, combined before they are shuffled; the driver gets the ``NAMES``
commonest.  A second pass scans, without a shuffle.  Byte masks over whole chunks pick out the few
documents that can hold a match; only these meet the expressions that give exact spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .text import LOWER, Words, byte_class, chunks, spans

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = re.compile(rb"password|passwd|secret|token|api_?key")
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|credential|private|bearer|signature|aws|access", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "novel")
HEX_BYTES = byte_class("0123456789abcdef")
DIGITS = byte_class("0123456789")
#: A candidate is novel when it adds at least this share of its length to the compressed surroundings.
NOVEL_SHARE, BEFORE, AFTER, NEAR = 0.75, 400, 200, 64
#: What counts as a name (no part of a longer string), and how many of the commonest prime the compressor (some 40 KB).
NAME, NAMES = r"(?<![A-Za-z0-9_+/=-])[A-Za-z_]{4,40}(?![A-Za-z0-9_+/=-])", 4000
#: Placeholders that stand where secrets would.
PLACEHOLDERS = "example placeholder changeme your_key_here INSERT_KEY_HERE XXXXXXXXXXXXXXXX xxxxxxxxxxxxxxxx 0000000000000000 1234567890 0123456789 0123456789abcdef 0123456789ABCDEF abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def common_names(docs: DataFrame, most: int = NAMES) -> list[str]:
    """The names that the most documents have, commonest last (the compressor reaches those best)."""
    names = F.array_distinct(F.regexp_extract_all(F.col("text").cast("string"), F.lit(NAME), F.lit(0)))
    counts = docs.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return [r["name"] for r in counts.orderBy(F.desc("n"), "name").limit(most).collect()][::-1]


class Scanner:
    def __init__(self, names: Sequence[str] = ()):
        prime = zstandard.ZstdCompressionDict(" ".join([*names, PLACEHOLDERS]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prime.precompute_compress(level=3)
        self.compressor = zstandard.ZstdCompressor(dict_data=prime, write_checksum=False, write_content_size=False, write_dict_id=False)

    def marginal(self, before: str, what: str, after: str) -> int:
        with_it = len(self.compressor.compress((before + after + "\n" + what).encode()))
        without = len(self.compressor.compress((before + after + "\n").encode()))
        return with_it - without

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns' matches."""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]

    def novel(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out, last = [], 0
        starts, reach = [], []  # base spans by start, and how far all spans up to each one reach
        for start, _, end in sorted(known):
            last = max(last, end)
            starts.append(start)
            reach.append(last)
        for m in CANDIDATE.finditer(text):
            s, e = m.span()
            what = m[0]
            before = bisect_right(starts, e - 1)  # spans that start before the candidate ends
            if before and reach[before - 1] > s or not (any(c.isdigit() for c in what) and any(c.isalpha() for c in what)):
                continue
            if not SENSITIVE.search(text, max(0, s - NEAR), s):
                continue
            if self.marginal(text[max(0, s - BEFORE) : s], what, text[e : e + AFTER]) >= NOVEL_SHARE * len(what):
                out.append((s, 3, e))
        return out


def suspects(column: pa.Array) -> np.ndarray:
    """True for documents that may hold a base match or a candidate."""
    w = Words(column)
    data, offs = w.data, w.offsets
    out = np.zeros(len(w.counts), bool)
    low = LOWER[data].tobytes()
    at = [m.start() for m in KEYWORDS.finditer(low)]
    raw, k = data.tobytes(), -1
    while (k := raw.find(b"AKIA", k + 1)) >= 0:
        at.append(k)
    starts, ends = spans(HEX_BYTES[data], offs)
    at = np.concatenate([np.array(at, np.int64), starts[ends - starts >= 32]])
    if len(w.starts):
        digits = np.concatenate([[0], np.cumsum(DIGITS[data])])
        mixed = (w.ends - w.starts >= 16) & (digits[w.ends] - digits[w.starts] > 0)
        at = np.concatenate([at, w.starts[mixed]])
    out[np.searchsorted(offs, at, "right") - 1] = True
    return out


def join_spans(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (code points, end exclusive).

    ``spans`` has the base spans and those of novel strings.  Defined results: null text is empty and has no spans; equal rows get equal rows; an empty table
    gives no rows; columns other than doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    names = docs.sparkSession.sparkContext.broadcast(common_names(docs))
    schema = docs.select("doc_id").schema
    for c, t in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")):
        schema = schema.add(c, t)
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        scanner = Scanner(names.value)
        for b in chunks(batches):
            texts, n = b.column(1), b.num_rows
            counts, sha, spans_ = np.zeros((3, n), np.int64), [none] * n, [""] * n
            for i in np.flatnonzero(suspects(texts)):
                text = texts[int(i)].as_py() or ""
                base = scanner.base(text)
                for _, k, _ in base:
                    counts[k, i] += 1
                sha[i] = hashlib.sha256(join_spans(base).encode()).hexdigest()
                spans_[i] = join_spans(base + scanner.novel(text, base))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in counts), pa.array(sha, pa.string()), pa.array(spans_, pa.string())], schema.fieldNames())

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def secrets_query(spark, sf_dir: str) -> DataFrame:
    """op6: base counts, digest and all spans of every document."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
