"""Vectorised text scanning shared by the operators: words, hashes, shingles.

A task handles documents in blocks of about a megabyte. A block is one byte
array in which a newline stands after every document, so no word crosses from
one document to the next, and all per-byte work is numpy.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm import tokens

# Freed batches go back to the system: a worker outlives its task, and the next one needs the room.
pa.set_memory_pool(pa.system_memory_pool())

#: glibc's malloc_trim, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SHINGLE_CODE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of the bytes in the given inclusive ranges."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: ``[^\x20\x09-\x0D]``
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, for text that is lower-cased already
ALNUM = ~byte_class((0, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit hangs on every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 1))
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.multiply.accumulate(np.full(m, BASE))])
            self.down = np.concatenate([one, np.multiply.accumulate(np.full(m, BASE_INV))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running sums P with hash(buf[s:e]) = (P[e] - P[s]) / BASE**s, modulo 2**64."""
    out = np.zeros(len(buf) + 1, np.uint64)
    up, _ = POWERS.upto(len(buf))
    np.cumsum(BYTE_CODE[buf] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the byte spans."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Block:
    """Documents ``rows[first:last]`` of a batch as one byte array, with their words."""

    def __init__(self, texts: list[bytes], table: np.ndarray, lower: bool) -> None:
        self.raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.raw, np.uint8)
        self.buf = LOWER[buf] if lower else buf
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.doc_end = np.cumsum(sizes + 1)
        self.doc_start = self.doc_end - sizes - 1
        self.n_docs = len(texts)
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[:-1] = table[self.buf]
        step = np.diff(inside, prepend=np.int8(0))
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        #: words of document i are word[first[i]:first[i + 1]]
        self.first = np.searchsorted(self.start, np.append(self.doc_start, len(self.buf)))
        self.n_words = np.diff(self.first)

    def word_hash(self) -> np.ndarray:
        return span_hash(prefix_hash(self.buf), self.start, self.end)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)


def shingle_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (those that cross documents included)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += words[j : j + m] * SHINGLE_CODE[j]
    return mix(out)


def run_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence shorter than a shingle; ``n`` words of it agree with shingle_hash(., n)."""
    return shingle_hash(words, len(words))[0]


def trim() -> None:
    """Gives freed memory back to the system."""
    if _TRIM is not None:
        _TRIM(0)


def begin_task() -> None:
    """Frees what the worker holds from earlier stages and gives freed memory back to the system."""
    task = TaskContext.get()
    if task is not None:
        tokens.forget(task.stageId())
    trim()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches: whole texts are wide rows, and several batches are held at once."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row ranges of the incoming batches with at most about ``size`` bytes of text each.

    A null text is the empty one. A single longer document makes a block of its own.
    """
    begin_task()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        col = col.cast(pa.large_binary())
        at = 0
        while at < batch.num_rows:
            texts, total = [], 0
            while at + len(texts) < batch.num_rows and (total < size) and len(texts) < 4096:
                t = col[at + len(texts)].as_py() or b""
                if texts and total + len(t) > size:
                    break
                texts.append(t)
                total += len(t) + 1
            yield batch.slice(at, len(texts)), texts
            at += len(texts)
    begin_task()


def record(schema: pa.Schema, **cols) -> pa.RecordBatch:
    """A batch of the given schema from arrays or lists."""
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in schema], schema=schema)
