"""Words of k letters: windows of reads in numpy, dealt out by minimiser.

Windows over the letters ACGT of up to ``PACKED`` letters are 64-bit integers of
two bits a letter, whose order is that of the texts; other windows are byte
strings. Letters are ASCII, and none is NUL. Reads travel as super-k-mers: stretches whose windows have one minimiser,
which is the same for all windows around one junction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut, spread

PACKED = 31
#: Letters of a minimiser.
MINIMISER = 7
#: Letters that a task holds at a time.
SLICE = 1 << 20
#: Letters under one minimiser beyond which its windows are dealt out one by one.
HEAVY = 1 << 23

_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_LETTER = np.frombuffer(b"ACGT", np.uint8)
#: Stands between reads, and in no read.
GAP = 0


def _rolled(values: np.ndarray, k: int, bits: int) -> np.ndarray:
    """For each place the ``k`` values from there on, side by side in ``bits`` bits each."""
    out, have = None, 0
    power, size = values.astype(np.uint64), 1
    while True:
        if k & size:
            # the stretch of ``size`` that follows what is there already
            if out is None:
                out, have = power, size
            else:
                n = min(len(out), max(0, len(power) - have))
                out, have = (out[:n] << np.uint64(bits * size)) | power[have : have + n], have + size
        if 2 * size > k:
            return out[: max(0, len(values) - k + 1)]
        n = max(0, len(power) - size)
        power, size = (power[:n] << np.uint64(bits * size)) | power[size : size + n], 2 * size


def _hashed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Windows:
    """The windows of ``k`` letters of reads that stand in one buffer, each closed by a gap."""

    def __init__(self, reads: list[bytes], k: int) -> None:
        self.k, self.buf = k, np.frombuffer(b"".join(r + b"\0" for r in reads), np.uint8)
        inside = np.concatenate([[0], np.cumsum(self.buf == GAP)])
        n = max(0, len(self.buf) - k + 1)
        #: where windows begin
        self.at = np.flatnonzero(inside[k : k + n] == inside[:n])

    def texts(self, at: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.buf, self.k) if len(self.buf) >= self.k else np.zeros((0, self.k), np.uint8)
        return np.ascontiguousarray(view[at]).view(f"S{self.k}").ravel() if len(at) else np.zeros(0, f"S{self.k}")

    def keys(self) -> np.ndarray:
        """The windows as integers where all are packed, else as byte strings."""
        code = _CODE[self.buf]
        if self.k <= PACKED and not ((code == 255) & (self.buf != GAP)).any():
            return _rolled(code & 3, self.k, 2)[self.at]
        return self.texts(self.at)

    def minimisers(self, skip: int) -> np.ndarray:
        """For each window the least hash of the short words in it, ``skip`` letters left out on either side."""
        m = max(1, min(MINIMISER, self.k - 2 * skip))
        words = _hashed(_rolled(self.buf, m, 8))
        width = self.k - 2 * skip - m + 1
        return (_least(words, width)[self.at + skip] >> np.uint64(1)).astype(np.int64)


def unpacked(keys: np.ndarray, k: int) -> np.ndarray:
    """Byte strings of packed windows."""
    if keys.dtype.kind == "S":
        return keys
    shift = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)
    return _LETTER[((keys[:, None] >> shift) & np.uint64(3)).astype(np.uint8)].view(f"S{k}").ravel()


def strings(texts: np.ndarray) -> pa.Array:
    """A string column of equally long byte strings."""
    size = texts.dtype.itemsize
    offsets = np.arange(0, (len(texts) + 1) * size, size, dtype=np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(texts)))


def _slices(batches: Iterator[pa.RecordBatch], k: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Reads in slices of bounded size, and the row of each; a longer read comes in stretches that hold each window once."""
    for batch in batches:
        reads, rows, total = [], [], 0
        for row, text in enumerate(batch.column(column)):
            text = (text.as_py() or "").encode()
            for at in range(0, max(1, len(text) - k + 1), SLICE):
                part = text[at : at + SLICE + k - 1]
                reads.append(part)
                rows.append(row)
                total += len(part) + 1
                if total >= SLICE:
                    yield batch, reads, np.array(rows)
                    reads, rows, total = [], [], 0
        if reads:
            yield batch, reads, np.array(rows)


def super_kmers(reads: DataFrame, k: int) -> DataFrame:
    """(bucket, letters): stretches of the reads' seq whose k-letter windows share the minimiser of their inner k - 2 letters, each once for a slice of the scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, _ in _slices(batches, k):
            w = Windows(texts, k)
            bucket = w.minimisers(1 if k > 2 else 0)
            edge = np.ones(len(w.at), bool)
            edge[1:] = (bucket[1:] != bucket[:-1]) | (np.diff(w.at) > 1)
            first = np.flatnonzero(edge)
            last = np.append(first[1:], len(w.at)) - 1
            raw = w.buf.tobytes()
            found = {(b, raw[s : e + k]) for b, s, e in zip(bucket[first].tolist(), w.at[first].tolist(), w.at[last].tolist(), strict=True)} if len(first) else set()
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x.decode() for _, x in found], pa.string())], names=["bucket", "letters"])

    return spread(reads).where(F.octet_length("seq") >= k).select("seq").mapInArrow(run, "bucket long, letters string")


def distinct_kmers(reads: DataFrame, k: int, heavy: int = HEAVY) -> DataFrame:
    """(kmer, bucket): the distinct k-letter windows of the reads' seq.

    A super-k-mer is shuffled once, to the task of its minimiser, and the windows
    are packed and made distinct there. Under a minimiser with more than ``heavy``
    letters the windows are dealt out by themselves instead.
    """
    supers, many = _supers(reads, k, heavy)
    run, out = _distinct(k), "kmer string, bucket long"
    if many is None:
        return supers.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, out)
    light = supers.join(many, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, out)
    return light.unionByName(supers.join(many, "bucket", "left_semi").mapInArrow(run, out).distinct())


def _supers(reads: DataFrame, k: int, heavy: int) -> tuple[DataFrame, DataFrame | None]:
    """Super-k-mers, written, and the minimisers (bucket) with more than ``heavy`` letters, if any."""
    supers = cut(super_kmers(reads, k), "super-kmers")
    many = cut(supers.groupBy("bucket").agg(F.sum(F.length("letters")).alias("n")).where(F.col("n") > heavy).select("bucket"), "heavy")
    return supers, None if many.isEmpty() else many


def _distinct(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (bucket, letters), sorted by bucket, to (kmer, bucket) with each bucket's windows once for a slice."""
    def windows(held: dict[int, list[bytes]]) -> pa.RecordBatch:
        kmers, buckets = [], []
        for bucket, texts in held.items():
            found = unpacked(np.unique(Windows(texts, k).keys()), k)
            kmers.append(strings(found))
            buckets.append(np.full(len(found), bucket))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(kmers), pa.array(np.concatenate(buckets))], names=["kmer", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        total = 0
        for batch in batches:
            for bucket, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if total >= SLICE and bucket not in held:
                    yield windows(held)
                    held, total = {}, 0
                held.setdefault(bucket, []).append(text.encode())
                total += len(text)
        if held:
            yield windows(held)

    return run


def _ends(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last k letters of windows of k + 1."""
    if keys.dtype.kind != "S":
        return keys >> np.uint64(2), keys & np.uint64((1 << (2 * k)) - 1)
    view = keys.view(np.uint8).reshape(len(keys), k + 1)
    return tuple(np.ascontiguousarray(part).view(f"S{k}").ravel() for part in (view[:, :-1], view[:, 1:]))


def _chained(texts: list[bytes], k: int) -> pa.RecordBatch:
    """(letters, path): the distinct windows of k + 1 letters of whole junctions, joined to paths where they merge, else one by one.

    A cycle of merging windows begins at its smallest k letters; the window that
    closes it stands by itself.
    """
    keys = np.unique(Windows(texts, k + 1).keys())
    n = len(keys)
    names, code = np.unique(np.concatenate(_ends(keys, k)), return_inverse=True)
    source, target, size = code[:n], code[n:], len(names)
    merges = np.flatnonzero((source != target) & (np.bincount(source, minlength=size)[source] == 1) & (np.bincount(target, minlength=size)[target] == 1))
    before = np.full(size, -1)
    before[target[merges]] = source[merges]
    head, dist = np.where(before >= 0, before, np.arange(size)), (before >= 0).astype(np.int64)
    for _ in range(size.bit_length()):
        far = head[head]
        if (far == head).all():
            break
        dist, head = dist + dist[head], far
    ring = before[head] >= 0
    for x in np.flatnonzero(ring).tolist():
        if ring[x]:
            loop = [x]
            while before[loop[-1]] != x:
                loop.append(int(before[loop[-1]]))
            at = loop.index(min(loop))
            # backwards from the root on
            loop = np.array([loop[at], *reversed(loop[at + 1 :] + loop[:at])])
            head[loop], dist[loop], ring[loop] = loop[0], np.arange(len(loop)), False
    merges = merges[dist[target[merges]] > 0]
    merges = merges[np.lexsort((dist[target[merges]], head[target[merges]]))]
    t = target[merges]
    first = np.flatnonzero(dist[t] == 1)
    steps = np.diff(np.append(first, len(t)))
    alone = np.ones(n, bool)
    alone[merges] = False
    # k letters of every head, and one more for each window behind it
    begin = np.concatenate([[0], np.cumsum(k + steps)]).astype(np.int64)
    buf = np.zeros(begin[-1], np.uint8)
    heads = unpacked(names[head[t[first]]], k).view(np.uint8).reshape(len(first), k) if len(first) else np.zeros((0, k), np.uint8)
    buf[(begin[:-1, None] + np.arange(k)).ravel()] = heads.ravel()
    last = unpacked(keys[merges], k + 1).view(np.uint8).reshape(len(merges), k + 1)[:, -1] if len(merges) else np.zeros(0, np.uint8)
    buf[np.repeat(begin[:-1], steps) + k - 1 + dist[t]] = last
    paths = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(begin), pa.py_buffer(buf)).cast(pa.string())
    others = unpacked(keys[alone], k + 1) if alone.any() else np.zeros(0, f"S{k + 1}")
    return pa.RecordBatch.from_arrays([pa.concat_arrays([paths, strings(others)]), pa.array(np.arange(len(first) + len(others)) < len(first))], names=["letters", "path"])


def paths(reads: DataFrame, k: int, heavy: int = HEAVY) -> DataFrame:
    """(letters, path): every distinct window of k + 1 letters of the reads' seq, in one row.

    A row is a path of windows that are the only ones out of their first and into
    their last k letters, as far as the minimisers of one task go, or one window
    that is not of that kind. Under a minimiser with more than ``heavy`` letters
    windows are dealt out by their inner letters.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        total, last = 0, None
        for batch in batches:
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if total >= SLICE and group != last:
                    yield _chained(held, k)
                    held, total = [], 0
                held.append(text.encode())
                total, last = total + len(text) + 1, group
        if held:
            yield _chained(held, k)

    def solved(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "letters string, path boolean")

    supers, many = _supers(reads, k + 1, heavy)
    if many is None:
        return solved(supers)
    dealt = supers.join(many, "bucket", "left_semi").mapInArrow(_distinct(k + 1), "kmer string, bucket long").distinct()
    dealt = dealt.select(F.xxhash64(F.substring("kmer", 2, k - 1)).alias("bucket"), F.col("kmer").alias("letters"))
    return solved(supers.join(many, "bucket", "left_anti")).unionByName(solved(dealt))


def _other_strand(keys: np.ndarray, k: int) -> np.ndarray:
    """Packed windows of the other strand."""
    out = np.zeros_like(keys)
    for j in range(k):
        out = (out << np.uint64(2)) | (np.uint64(3) - ((keys >> np.uint64(2 * j)) & np.uint64(3)))
    return out


_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)


def canonical(keys: np.ndarray, k: int) -> np.ndarray:
    """The smaller of each window and its other strand."""
    if keys.dtype.kind != "S":
        return np.minimum(keys, _other_strand(keys, k))
    back = np.ascontiguousarray(_COMPLEMENT[keys.view(np.uint8).reshape(len(keys), k)[:, ::-1]]).view(f"S{k}").ravel()
    return np.where(back < keys, back, keys)


def sample_counts(reads: DataFrame, k: int, by_read: bool, strands: bool = True) -> DataFrame:
    """(sample_id, kmer, n): windows of the reads (sample_id, seq) by sample, canonical ones if ``strands``; with ``by_read`` a read counts once.

    Every task sums what its slices hold before anything is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, rows in _whole(batches) if by_read else _slices(batches, k, 1):
            w = Windows(texts, k)
            keys = w.keys()
            keys = canonical(keys, k) if strands else keys
            read = np.repeat(rows, [max(0, len(t) - k + 1) for t in texts])
            sample = batch.column(0).dictionary_encode()
            of = sample.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names, key = np.unique(keys, return_inverse=True)
            if by_read:
                pair = np.unique(read * (len(names) + 1) + key)
                read, key = pair // (len(names) + 1), pair % (len(names) + 1)
            group, n = np.unique((of[read] + 1) * (len(names) + 1) + key, return_counts=True)
            known = pa.array((group // (len(names) + 1) - 1), mask=group < len(names) + 1)
            texts_ = unpacked(names, k)[group % (len(names) + 1)] if len(names) else np.zeros(0, f"S{k}")
            yield pa.RecordBatch.from_arrays([sample.dictionary.take(known.cast(pa.int32())), strings(texts_), pa.array(n)], names=["sample_id", "kmer", "n"])

    def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                upto, total = at, 0
                while upto < len(texts) and (upto == at or total < SLICE):
                    total += len(texts[upto]) + 1
                    upto += 1
                yield batch, texts[at:upto], np.arange(at, upto)
                at = upto

    rows = spread(reads).where(F.octet_length("seq") >= k).select(F.col("sample_id").cast("string").alias("sample_id"), "seq").mapInArrow(run, "sample_id string, kmer string, n long")
    return rows.groupBy("sample_id", "kmer").agg(F.sum("n").alias("n"))
