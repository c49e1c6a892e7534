"""Counts of a document block, all by numpy over the block's bytes."""

from __future__ import annotations

import numpy as np

from tessera.llm.scan import SPACED, Block, byte_class, mix, prefix_hash, shingle_hash, span_hash

SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = byte_class((65, 90))
LETTER = byte_class((65, 90), (97, 122), (128, 255))
DIGIT = byte_class((48, 57))
STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b".,;:!?'\"()-", np.uint8))
HEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _per(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each span."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


class Stats:
    """Per-document arrays; words are runs of non-space bytes, lines end at newlines."""

    def __init__(self, texts: list[bytes]) -> None:
        b = self.block = Block(texts, SPACED, lower=False)
        n = b.n_docs
        self.n_words = b.n_words.astype(np.int64)
        doc = b.word_doc()
        chars = _per(HEAD[b.buf], b.start, b.end)
        self.word_chars = np.bincount(doc, chars, n).astype(np.int64)
        self.n_symbols = _per(SYMBOL[b.buf], b.doc_start, b.doc_end - 1)
        prefix = prefix_hash(b.buf)
        self._lines(prefix)
        words = span_hash(prefix, b.start, b.end)
        self.n_repeat_words = self._repeats(words, doc)
        self.word_hash, self.word_doc, self.chars = words, doc, chars

    def _lines(self, prefix: np.ndarray) -> None:
        b = self.block
        end = np.flatnonzero(b.buf == 10)
        start = np.append(0, end[:-1] + 1)
        doc = np.searchsorted(b.doc_end, start, "right")
        full = np.searchsorted(b.start, end) > np.searchsorted(b.start, start)
        self.line_start, self.line_end, self.line_doc = start[full], end[full], doc[full]
        n = b.n_docs
        self.n_lines = np.bincount(self.line_doc, minlength=n).astype(np.int64)
        line = span_hash(prefix, self.line_start, self.line_end)
        distinct = np.unique(mix(line + self.line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        self.n_dup_lines = self.n_lines - np.bincount(self.line_doc[distinct], minlength=n)

    def _repeats(self, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Words inside 3-word windows that occur twice or more in their document."""
        n = self.block.n_docs
        grams = shingle_hash(words, 3)
        at = np.flatnonzero(doc[2:] == doc[:-2]) if len(words) > 2 else np.zeros(0, np.int64)
        key = mix(grams[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = np.zeros(len(words) + 3, bool)
        s = at[count[which] > 1]
        for j in range(3):
            hit[s + j] = True
        return np.bincount(doc[hit[: len(words)]], minlength=n).astype(np.int64)

    def features(self) -> np.ndarray:
        """(documents, len(FEATURES)) float32 for the quality classifier."""
        b, n = self.block, self.block.n_docs
        s, e = b.doc_start, b.doc_end - 1
        per = lambda table: _per(table[b.buf], s, e)
        size, words, lines = np.maximum(e - s, 1), np.maximum(self.n_words, 1), np.maximum(self.n_lines, 1)
        letters = np.maximum(per(LETTER), 1)
        caps = _per(UPPER[b.buf], b.start, b.end)
        shout = np.bincount(self.word_doc, (caps >= 2) & (caps >= _per(LETTER[b.buf], b.start, b.end)), n)
        unique = np.bincount(self.word_doc[np.unique(mix(self.word_hash + self.word_doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)[1]], minlength=n)
        longest = np.zeros(n)
        np.maximum.at(longest, self.word_doc, self.chars)
        square = np.bincount(self.word_doc, self.chars.astype(float) ** 2, n)
        mean = self.word_chars / words
        stops = np.bincount(self.line_doc, STOP[b.buf[self.line_end - 1]], n)
        piped = np.bincount(self.line_doc, _per(b.buf == ord("|"), self.line_start, self.line_end) > 0, n)
        odd_end = np.bincount(self.word_doc, SYMBOL[b.buf[b.end - 1]], n)
        short = np.bincount(self.word_doc, self.chars == 1, n)
        out = np.stack(
            [
                np.log1p(self.n_words), np.log1p(self.n_lines), mean, np.sqrt(np.maximum(square / words - mean**2, 0)), longest,
                per(UPPER) / letters, per(DIGIT) / size, (size - per(byte_class((0, 127)))) / size, per(PUNCTUATION) / size, self.n_symbols / size,
                per(STOP) / words, shout / words, odd_end / words, short / words, unique / words,
                self.n_dup_lines / lines, self.n_repeat_words / words, words / lines, stops / lines, piped / lines, letters / size,
            ],
            1,
        )
        return out.astype(np.float32)


FEATURES = 21
