"""Document statistics, computed on whole texts with byte masks and word hashes."""

from __future__ import annotations

import numpy as np

from .text import CONTINUATION, Words, byte_class, span_hashes, spans, sums, windows

SYMBOLS = byte_class("#*$%&|<>")
UPPER = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
DIGIT = byte_class("0123456789")
STOP = byte_class(".!?")
PUNCT = byte_class(".,;:!?'\"()[]{}-/")
BANG = byte_class("!")
BAR = byte_class("|")
NEWLINE = 10


def repeated_in_doc(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: is it found twice or more in its document, and is it a later one of those."""
    order = np.lexsort((np.arange(len(h)), h, owner))
    hs, os_ = h[order], owner[order]
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (hs[1:] == hs[:-1]) & (os_[1:] == os_[:-1])
    multi = same.copy()
    multi[:-1] |= same[1:]
    out, later = np.empty(len(h), bool), np.empty(len(h), bool)
    out[order], later[order] = multi, same
    return out, later


class Stats:
    """Counts of a chunk's documents, one array entry a document."""

    def __init__(self, column):
        w = self.words = Words(column)
        data, offs, first = w.data, w.offsets, w.first
        n = len(data)
        at = lambda mask: sums(mask[data], offs)
        self.n_words = w.counts.astype(np.int64)
        text_points = sums(~CONTINUATION[data], offs)
        word_bytes = sums(w.ends - w.starts, first)
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, w.starts, 1)
        np.add.at(inside, w.ends, -1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        self.word_chars = sums(inside & ~CONTINUATION[data], offs)
        self.n_symbols = at(SYMBOLS)
        h = w.hashes()
        self.owner = w.doc()
        lines_from, lines_to = spans(data != NEWLINE, offs)
        word_line = np.searchsorted(lines_from, w.starts, "right") - 1
        worded = np.unique(word_line)
        lh = span_hashes(data, lines_from[worded], lines_to[worded]) if len(worded) else np.zeros(0, np.uint64)
        line_doc = np.searchsorted(offs, lines_from[worded], "right") - 1
        _, later = repeated_in_doc(lh, line_doc)
        docs = len(w.counts)
        self.n_dup_lines = np.bincount(line_doc[later], minlength=docs)
        self.n_lines = np.bincount(line_doc, minlength=docs)
        wh, pos = windows(h, first, 3)
        twice, _ = repeated_in_doc(wh, self.owner[pos])
        cover = np.zeros(len(h) + 1, np.int32)
        hit = pos[twice]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 3, -1)
        self.n_repeat_words = sums(np.cumsum(cover[:-1]) > 0, first)
        again, later_word = repeated_in_doc(h, self.owner)
        self.n_distinct = self.n_words - sums(later_word, first)
        self.n_upper, self.n_letters, self.n_digits = at(UPPER), at(LETTER), at(DIGIT)
        self.n_punct, self.n_bang, self.n_bar = at(PUNCT), at(BANG), at(BAR)
        self.n_chars = text_points
        last = data[w.ends - 1] if len(h) else np.zeros(0, np.uint8)
        head = data[w.starts] if len(h) else np.zeros(0, np.uint8)
        self.n_stop_words = sums(STOP[last], first)
        self.n_symbol_ends = sums(SYMBOLS[last], first)
        self.n_capital_words = sums(UPPER[head], first)
        adjacent = np.zeros(len(h), bool)
        if len(h):
            adjacent[1:] = (h[1:] == h[:-1]) & (self.owner[1:] == self.owner[:-1])
        self.n_adjacent = sums(adjacent, first)
        self.n_long_words = sums((w.ends - w.starts) > 20, first)
        self.n_short_words = sums((w.ends - w.starts) <= 3, first)
        self.word_bytes = word_bytes
