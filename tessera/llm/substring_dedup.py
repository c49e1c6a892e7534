"""Exact removal of repeated byte strings with suffix arrays.

A byte goes where a ``length``-byte string covers it that also starts anywhere
else in the corpus. Strings are found in two steps:

1. *Anchors.* Of the ``GRAM``-byte strings inside a window of ``length`` bytes
   the one with the smallest hash (the leftmost of equals) is the window's
   anchor. Equal windows have equal anchors at equal offsets, so all copies of
   a window meet under one anchor hash; neighbouring windows mostly share their
   anchor, and such a run of windows is one row. Rows whose anchor hash is
   unique are done.
2. *Suffix arrays.* Different contents under one anchor are sorted as suffixes
   (:mod:`tessera.llm.suffix_groups`), a few anchors at a time: a window is
   repeated exactly where the next or previous suffix starts with the same
   ``length`` bytes. Runs of equal bytes (by a 128-bit cryptographic digest of
   them) count as one string with a weight, since a weight over one already
   makes each of its windows repeated.

Anchors with more than ``MEMBERS`` different contents are not gathered: their
runs are cut into shorter ones keyed by the bytes that all windows of the
shorter run share, and go through the same steps again. A run of one window is
its own key, so this ends, and nothing is dropped on the way. Copies are counted
by partial sums and joined back, so an anchor that is everywhere gathers in no task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.cut import cut, settled
from tessera.llm.rows import named, unpacked
from tessera.llm.scan import POWERS, begin_task, mix, prefix_hash, record, small_batches
from tessera.llm.suffix_groups import joined, suffix_array

GRAM = 64
#: Window starts in one slice of a long text; a slice is one array of the scan.
SLICE = 1 << 20
MEMBERS = 256
#: Window starts of one anchor that share a key when large groups are cut, round by round.
STEPS = (16, 4, 1)
#: Bytes of text that one suffix array covers, beyond which it takes no further group.
UNIT = 1 << 15
POSITION_BITS = 22
U64 = np.uint64

#: A document is known by ``doc`` and ``mark`` (see :func:`tessera.llm.rows.named`).
ROW = "key long, content binary, doc long, mark long, start int, windows int, reach int"
SPAN = "doc long, mark long, a int, b int"
PLACE = [("doc", pa.int64()), ("mark", pa.int64()), ("start", pa.int32())]
ROW_ARROW = pa.schema([("key", pa.int64()), ("content", pa.binary()), *PLACE, ("windows", pa.int32()), ("reach", pa.int32())])
CUT_ARROW = pa.schema([*ROW_ARROW, ("copies", pa.int64()), ("members", pa.int64()), ("bytes", pa.binary())])
SHORT_ARROW = pa.schema([*ROW_ARROW, ("weight", pa.int64()), ("bytes", pa.binary())])
SPAN_ARROW = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least of each ``width`` consecutive values (their low bits are overwritten)."""
    low = U64((1 << POSITION_BITS) - 1)
    m = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    return (m & low).astype(np.int64)


def runs(buf: bytes, piece_start: np.ndarray, piece_end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one anchor inside the pieces: (start, windows, anchor key, distance from the start to the anchor)."""
    data = np.frombuffer(buf, np.uint8)
    prefix = prefix_hash(data)
    gram = min(GRAM, length)
    _, down = POWERS.upto(len(prefix))
    grams = mix((prefix[gram:] - prefix[:-gram]) * down[: len(prefix) - gram])
    anchor = sliding_argmin(grams, length - gram + 1)
    # a window belongs to a piece where it starts early enough in it
    inside = np.zeros(len(data) + 1, np.int32)
    ok = piece_end - piece_start >= length
    np.add.at(inside, piece_start[ok], 1)
    np.add.at(inside, piece_end[ok] - length + 1, -1)
    valid = np.cumsum(inside[: len(anchor)]) > 0
    edge = np.ones(len(anchor), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    edge[piece_start[ok]] = True
    start = np.flatnonzero(edge & valid)
    stop = np.flatnonzero(np.append(edge[1:] | ~valid[1:], True) & valid) + 1
    where = anchor[start]
    return start, stop - start, grams[where], where - start


def _digest(data: bytes, salt: int = 0) -> bytes:
    return hashlib.blake2b(data, digest_size=16, salt=salt.to_bytes(8, "little")).digest()


FIRST = ROW + ", weight long, others array<struct<doc:long,mark:long,start:int>>"
FIRST_ARROW = pa.schema([*ROW_ARROW, ("weight", pa.int64()), ("others", pa.list_(pa.struct(PLACE)))])


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """(key, content, doc, mark, start, windows, reach, weight, others): runs of windows by anchor; ``content`` digests their bytes.

    Equal runs of one slice of the scan come as one row with the places of the
    others, so a line or document that is everywhere gives a row for each slice.
    """
    def scan(pieces: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        sizes = np.fromiter((len(p[3]) for p in pieces), np.int64, len(pieces))
        end = np.cumsum(sizes)
        begin = end - sizes
        buf = b"".join(p[3] for p in pieces)
        start, n, key, reach = runs(buf, begin, end, length)
        content = [_digest(buf[s:e]) for s, e in zip(start.tolist(), (start + n - 1 + length).tolist(), strict=True)]
        of = np.searchsorted(end, start, "right")
        doc, mark, at = (np.array([p[k] for p in pieces], np.int64)[of] for k in range(3))
        start = (start + at - begin[of]).astype(np.int32)
        nth: dict[bytes, int] = {}
        first: list[int] = []
        others: list[list | None] = []
        for i, c in enumerate(content):
            k = nth.setdefault(c, len(first))
            if k == len(first):
                first.append(i)
                others.append(None)
            else:
                others[k] = others[k] or []
                others[k].append({"doc": int(doc[i]), "mark": int(mark[i]), "start": int(start[i])})
        return record(
            FIRST_ARROW, key=key[first].view(np.int64), content=list(nth), doc=doc[first], mark=mark[first], start=start[first],
            windows=n[first].astype(np.int32), reach=reach[first].astype(np.int32), weight=[1 + len(o or ()) for o in others], others=others,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        held, total = [], 0
        for batch in batches:
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                text = text.as_py()
                if text is None or len(text) < length:
                    continue
                for at in range(0, len(text) - length + 1, SLICE):
                    piece = text[at : at + SLICE + length - 1]
                    held.append((doc, mark, at, piece))
                    total += len(piece)
                    if total >= SLICE // 2:
                        yield scan(held)
                        held, total = [], 0
        if held:
            yield scan(held)

    return texts.select("doc", "mark", "text").mapInArrow(run, FIRST)


def _judged(make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
    """Of the rows that ``make`` gives those whose anchor another row has too, and one row for each (key, content) of theirs, both written.

    The second table has the number of ``copies`` of a content and of different
    contents (``members``) under its key, and one place. Every count is a
    partial sum before it is shuffled.
    """
    def shared() -> DataFrame:
        every = cut(make(), "runs")
        return every.join(every.groupBy("key").agg(F.sum("weight").alias("all")).where("all > 1").select("key"), "key", "left_semi")

    rows = settled(shared, name)
    also = ["bytes"] if "bytes" in rows.columns else []
    # all firsts come from one row: they are filled together
    one = [F.first(c).alias(c) for c in ("doc", "mark", "start", "windows", "reach", *also)]
    contents = rows.groupBy("key", "content").agg(F.sum("weight").alias("copies"), *one)

    def counted() -> DataFrame:
        each = cut(contents, "contents")
        return each.join(each.groupBy("key").agg(F.count("*").alias("members")), "key")

    return rows, settled(counted, f"{name}-contents")


def _found(rows: DataFrame, contents: DataFrame, length: int) -> DataFrame:
    """Spans of the rows whose whole content is repeated; in later rounds heavier rows have given theirs already."""
    span = f"start + windows - 1 + {length} as b"
    rows = rows.join(contents.where("copies > 1").select("key", "content"), ["key", "content"], "left_semi")
    if "others" not in rows.columns:
        return rows.where("weight = 1").selectExpr("doc", "mark", "start as a", span)
    places = rows.select("windows", F.explode(F.concat(F.array(F.struct("doc", "mark", "start")), F.coalesce("others", F.expr("array()")))).alias("p"))
    return places.selectExpr("p.doc", "p.mark", "p.start", "windows").selectExpr("doc", "mark", "start as a", span)


def _with_bytes(contents: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Adds the bytes that the contents' windows cover."""
    names = CUT_ARROW.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                col = dict(zip(part.schema.names, part.columns, strict=True))
                text = col["text"].cast(pa.large_binary())
                of = zip(text, col["start"].to_pylist(), col["windows"].to_pylist(), strict=True)
                col["bytes"] = pa.array([t.as_py()[s : s + w - 1 + length] for t, s, w in of], pa.binary())
                yield pa.RecordBatch.from_arrays([col[f] for f in names], schema=CUT_ARROW)

    once = texts.dropDuplicates(["doc", "mark"])  # repeated rows are one text
    wanted = contents.select(*names[:-1])
    return wanted.join(once, ["doc", "mark"]).select(*names[:-1], "text").mapInArrow(run, ROW + ", copies long, members long, bytes binary")


def repeated_windows(strings: Sequence[bytes], length: int) -> list[np.ndarray]:
    """For each string the window starts whose ``length`` bytes start more than once in all strings together."""
    text, begins = joined(strings)
    owner = [-1] * len(text)  # of the suffixes that begin a window
    for k, (b, s) in enumerate(zip(begins, strings, strict=True)):
        n = max(0, len(s) - length + 1)
        owner[b : b + n] = [k] * n
    hit = bytearray(len(text))
    last, at, held = None, 0, False
    for s in suffix_array(text):
        k = owner[s]
        if k < 0:
            continue
        o = s - begins[k]
        window = strings[k][o : o + length]
        if window != last:
            last, held = window, False
        else:
            if not held:
                hit[at] = held = True
            hit[s] = True
        at = s
    return [np.flatnonzero(np.frombuffer(hit, np.uint8)[b : b + len(s)]) for b, s in zip(begins, strings, strict=True)]


def _as_runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    gap = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)]


def _sorted_out(contents: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows in contents (key, doc, mark, start, copies, bytes) that occur once."""
    def solve(unit: list[tuple]) -> pa.RecordBatch:
        doc, mark, a, b = [], [], [], []
        for (_, d, m, start, copies, _), found in zip(unit, repeated_windows([r[5] for r in unit], length), strict=True):
            if copies == 1 and len(found):
                lo, hi = _as_runs(found)
                doc += [d] * len(lo)
                mark += [m] * len(lo)
                a += (lo + start).tolist()
                b += (hi + start + length).tolist()
        return record(SPAN_ARROW, doc=doc, mark=mark, a=a, b=b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        unit, total = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total >= UNIT and r[0] != unit[-1][0]:
                    yield solve(unit)
                    unit, total = [], 0
                unit.append(r)
                total += len(r[5])
        if unit:
            yield solve(unit)

    cols = ["key", "doc", "mark", "start", "copies", "bytes"]
    return contents.select(*cols).repartition("key").sortWithinPartitions("key").mapInArrow(run, SPAN)


def _shorten(contents: DataFrame, length: int, step: int) -> DataFrame:
    """Each run as runs of at most ``step`` windows, keyed by the bytes that all windows in that stretch share.

    Stretches are counted from the anchor, so that equal windows stay together.
    A run that has copies weighs two.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f: [] for f in SHORT_ARROW.names}
            for doc, mark, start, n, reach, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for stretch in range((reach - n + 1) // step, reach // step + 1):
                    far, near = min(reach, stretch * step + step - 1), max(reach - n + 1, stretch * step)
                    first, m = reach - far, far - near + 1
                    core = data[reach - stretch * step : reach - stretch * step - step + 1 + length]
                    part = data[first : first + m - 1 + length]
                    key = int.from_bytes(_digest(core, stretch % 2**32)[:8], "little", signed=True)
                    values = (key, _digest(part, far), doc, mark, start + first, m, far, min(copies, 2), part)
                    for f, v in zip(out.values(), values, strict=True):
                        f.append(v)
            yield record(SHORT_ARROW, **out)

    cols = ["doc", "mark", "start", "windows", "reach", "copies", "bytes"]
    return contents.select(*cols).mapInArrow(run, ROW + ", weight long, bytes binary")


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """(doc, mark, a, b): byte spans, possibly overlapping, of texts (doc, mark, text) that together cover exactly the repeated strings."""
    rows, contents = _judged(lambda: anchors(texts, length), "shared")
    spans = [_found(rows, contents, length)]
    contents = cut(_with_bytes(contents.where("members > 1"), texts, length), "open")
    for step in STEPS:
        spans.append(_sorted_out(contents.where(f"members <= {MEMBERS}"), length))
        large = contents.where(f"members > {MEMBERS}")
        if large.isEmpty():
            break
        rows, contents = _judged(lambda: _shorten(large, length, step), "shared")
        spans.append(_found(rows, contents, length))
        contents = contents.where("members > 1")
    return reduce(DataFrame.unionByName, spans)


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """(row, text, spans) for every row of ``docs``; ``spans`` is null where nothing is repeated."""
    rows = named(small_batches(docs), "text")
    texts = rows.select("doc", "mark", "text")
    spans = settled(lambda: repeated_spans(texts, length).groupBy("doc", "mark").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    return rows.join(spans, ["doc", "mark"], "left").select("row", "text", "spans")


def _kept(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of ``text``, and the number of maximal removed runs."""
    kept, upto, n = [], 0, 0
    for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
        if not n or a > upto:
            kept.append(text[upto:a])
            n += 1
        upto = max(upto, b)
    return b"".join(kept) + text[upto:], n


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def dedup_substrings(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    The UTF-8 bytes that a repeated ``length``-byte string covers go; n_spans
    counts maximal removed runs, and the digest is of the other bytes,
    concatenated. Matches never cross documents, and overlapping occurrences in
    one document count.

    A null text is the empty one. Texts below ``length`` bytes lose nothing.
    Rows that repeat a doc_id with other texts, and rows without a doc_id, are
    documents of their own; rows that repeat both are copies of each other and
    lose what they share. Other columns are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: dict[str, list] = {f: [] for f in RESULT_ARROW.names}
                for doc, text, spans in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()), part.column(2).to_pylist(), strict=True):
                    text = text.as_py() or b""
                    kept, n = _kept(text, spans)
                    for f, v in zip(out.values(), (doc, len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest()), strict=True):
                        f.append(v)
                yield record(RESULT_ARROW, **out)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(docs, length).select("row.doc_id", "text", "spans").mapInArrow(run, RESULT)


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs``, all rows and columns, with the repeated bytes gone from ``text``; a code point that a removed run tears is dropped.

    Rows are told apart as in :func:`dedup_substrings`; a null text stays null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = part.column(1).cast(pa.large_binary())
                kept = [_kept(t.as_py(), s)[0].decode(errors="ignore") if s else t.as_py() for t, s in zip(text, part.column(2).to_pylist(), strict=True)]
                kept = [k.decode() if isinstance(k, bytes) else k for k in kept]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string())], names=["row", "text"])

    found = _with_spans(docs, length)
    schema = StructType([found.schema["row"], StructField("text", StringType())])
    return unpacked(found.mapInArrow(run, schema), docs.columns, "text")
