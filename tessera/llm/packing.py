"""Best-fit packing of documents into sequences, after dominance reduction.

Only the lengths decide a packing, and there are at most ``capacity`` of them.
So Spark counts the pieces of each length, the plan is made on those counts
(one number per length, whatever the corpus size) as *patterns* that are used
many times over, and every piece finds its place from its rank among the pieces
of its length. No piece list is ever gathered.

The plan follows Martello and Toth: from the longest length down, a set of at
most three pieces that dominates every other set holding that length is fixed
for good (an exact fit; the best single partner where no two others fit beside
it; a pair that no pair beats). What is left is packed by best fit decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.llm.scan import record, small_batches, text_blocks
from tessera.llm.tokens import END, encoder

Pattern = tuple[tuple[int, int], ...]


def dominating_sets(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Fixes dominating sets and takes their pieces out of ``counts``; (lengths with multiplicity, times) for each."""
    fixed: list[tuple[Pattern, int]] = []

    def fix(times: int, *lengths: int) -> None:
        for w in lengths:
            counts[w] -= times
        fixed.append((tuple(sorted(((w, lengths.count(w)) for w in set(lengths)), reverse=True)), times))

    for w in range(capacity, 0, -1):
        while counts[w]:
            room = capacity - w
            counts[w] -= 1  # the piece itself is no partner of its own
            sizes = np.flatnonzero(counts[: room + 1])
            fits = _most_that_fit(counts, sizes, room)
            best = int(sizes[-1]) if len(sizes) else 0
            pair = _best_pair(counts, sizes, room) if fits == 2 and best != room else None
            counts[w] += 1
            if not fits:
                fix(int(counts[w]), w)
            elif best == room or fits == 1 or (pair and best >= sum(pair)):
                fix(_times(counts, w, best), w, best)
            elif pair and pair[0] == best and _unbeaten(counts, w, pair, room):
                fix(_times(counts, w, *pair), w, *pair)
            else:
                break
    return fixed


def _times(counts: np.ndarray, *lengths: int) -> int:
    return int(min(counts[w] // lengths.count(w) for w in lengths))


def _most_that_fit(counts: np.ndarray, sizes: np.ndarray, room: int) -> int:
    """How many of the shortest pieces fit into ``room`` together, at most 3."""
    n = 0
    for s in sizes[:3]:
        for _ in range(min(int(counts[s]), 3 - n)):
            if s > room:
                return n
            room -= int(s)
            n += 1
    return n


def _best_pair(counts: np.ndarray, sizes: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two pieces with the largest sum up to ``room``, the one with the longest first piece of equals."""
    best: tuple[int, int] | None = None
    for a in map(int, sizes[::-1]):
        k = int(np.searchsorted(sizes, min(a, room - a), "right")) - 1
        while k >= 0 and int(sizes[k]) == a and counts[a] < 2:
            k -= 1
        if k >= 0 and (best is None or a + int(sizes[k]) > sum(best)):
            best = (a, int(sizes[k]))
    return best


def _unbeaten(counts: np.ndarray, w: int, pair: tuple[int, int], room: int) -> bool:
    """Martello and Toth's condition that no two pieces between the pair's fit beside ``w``."""
    a, b = pair
    if a == b:
        return True
    between: list[int] = []
    for s in range(b + 1, a + 1):
        free = int(counts[s]) - (s == a) - (s == w)
        between += [s] * min(max(free, 0), 2 - len(between))
        if len(between) == 2:
            return sum(between) > room
    return True


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing over counts: bins of equal content are one entry with a number."""
    bins: dict[tuple[int, Pattern], int] = {}
    rooms: list[tuple[int, Pattern]] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if (room, pattern) not in bins:
                insort(rooms, (room, pattern))
                bins[room, pattern] = 0
            bins[room, pattern] += n

    for w in range(capacity, 0, -1):
        left = int(counts[w])
        while left:
            k = bisect_left(rooms, (w, ()))
            room, pattern = rooms[k] if k < len(rooms) else (capacity, ())
            each = room // w
            open_bins = bins.get((room, pattern), left)
            full = min(open_bins, left // each)
            some = 0 if full == open_bins else min(left - full * each, each)
            if pattern:
                del rooms[k]
                del bins[room, pattern]
                put(room, pattern, open_bins - full - bool(some))
            put(room - each * w, (*pattern, (w, each)), full)
            left -= full * each
            if some:
                put(room - some * w, (*pattern, (w, some)), 1)
                left -= some
        counts[w] = 0
    return [(pattern, n) for (_, pattern), n in bins.items()]


class Plan:
    """Where the r-th piece of each length goes."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        counts = counts.astype(np.int64).copy()
        taken = np.zeros(capacity + 1, np.int64)
        rows, sequence = [], 0
        for pattern, times in dominating_sets(counts, capacity) + best_fit(counts, capacity):
            offset = 0
            for w, m in pattern:
                rows.append(((w << 44) + int(taken[w]), m, sequence, offset, w))
                taken[w] += times * m
                offset += w * m
            sequence += times
        self.sequences = sequence
        self.key, self.copies, self.first, self.offset, self.length = np.array(sorted(rows), np.int64).reshape(-1, 5).T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these ranks (from 0) among those of their length."""
        k = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        nth = rank - (self.key[k] - (self.length[k] << 44))
        return self.first[k] + nth // self.copies[k], self.offset[k] + nth % self.copies[k] * length


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of that length in the task ``part``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        close = int(end).to_bytes(4, "little")
        for batch, texts in text_blocks(batches):
            out: dict[str, list] = {f.name: [] for f in PIECE}
            for doc, ids in zip(batch.column(0).to_pylist(), tool.encode(texts), strict=True):
                ids += close
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    size = n if n <= capacity else (n % capacity or capacity) if not k else capacity
                    values = (doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), part, seen[size])
                    seen[size] += 1
                    at += size
                    for f, v in zip(out.values(), values, strict=True):
                        f.append(v)
            yield record(PIECE, **out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    A document is its ids and the end id; one longer than ``capacity`` is cut
    into pieces of that size, of which the first may be shorter. A null or empty
    text is the end id alone. Repeated rows and null doc_ids are documents of
    their own; other columns are ignored; an empty table gives no rows. Ties
    between pieces of one length are settled by their place in the scan.
    """
    spark = docs.sparkSession
    cutting = cut(pieces(small_batches(docs), tokenizer, capacity), "pieces")
    per_part = cutting.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part")
    ranks = cut(per_part.withColumn("upto", F.sum("n").over(before)), "ranks")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in ranks.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    plan = spark.sparkContext.broadcast(Plan(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = plan.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cutting.join(ranks, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("upto - n + nth").alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
