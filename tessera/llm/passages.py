"""Removal of repeated word passages with prefix-partitioned suffix trees.

A word goes where a window of ``window`` words covers it that also starts in a
document with a smaller doc_id. Only suffixes of the corpus that can lie below a
deep internal node of its suffix tree are looked at, and they are split by prefix:

1. *Sync points.* Of the ``PREFIX``-word strings inside a window the one with the
   smallest hash (the leftmost of equals) is the window's sync point. Equal
   windows have equal ones at equal offsets, so all copies of a window meet under
   one prefix, and neighbouring windows that share a sync point form a run.
   Prefixes that one document alone holds are dropped: hashes are dealt out in
   buckets of bounded size, and what a task has seen in two documents needs no answer.
2. *Contents.* The other runs' words are read from the texts. Of equal contents
   in a slice of the scan the smallest doc_id stands for the others, which are
   repeated by that alone.
3. *Subtrees.* Runs are grouped by prefix, several prefixes to a suffix tree. Its
   leaves are the suffixes that begin a window, led by the prefix's number, so
   the root's children are the prefixes; the topmost internal nodes that spell
   ``window`` words or more are the maximal repeats, and a window goes where such
   a node holds a leaf of a smaller doc_id.
4. *Longer prefixes.* Under a prefix with more than ``MEMBERS`` runs each window
   is keyed by all its words instead (a 128-bit digest of them): there a group is
   itself a deep node, and its smallest doc_id is a partial aggregate that gathers
   in no task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.cut import cut, settled
from tessera.llm.rows import named, unpacked
from tessera.llm.scan import BLOCK_BYTES, SPACED, Block, begin_task, record, shingle_hash, small_batches
from tessera.llm.substring_dedup import sliding_argmin

PREFIX = 4
#: Runs that a task holds before it sends them on, and contents.
SLICE = 1 << 18
CONTENTS = 1 << 17
#: Bytes of text whose runs one bucket gets, on average.
BUCKET_BYTES = 64 << 20
#: Runs under one prefix beyond which its windows are keyed by all their words.
MEMBERS = 1 << 14
#: Leaves of one suffix tree, beyond which it takes no further prefix.
LEAVES = 1 << 15
#: Longer words stand as their digest.
WORD_BYTES = 4096
LONG_WORD = re.compile(rb"[^\x20\x09-\x0D]{%d,}" % (WORD_BYTES + 1))
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: A document without an id comes after all others.
LAST = 2**63 - 1

BLOB = "bucket int, key binary, doc binary, mark binary, run binary, open boolean"
BLOB_ARROW = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("key", "doc", "mark", "run")], ("open", pa.bool_())])
RUNS = "doc long, mark long, runs array<long>"
RUNS_ARROW = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("runs", pa.list_(pa.int64()))])
PLACES = pa.list_(pa.struct([("doc", pa.int64()), ("mark", pa.int64()), ("start", pa.int32())]))
PLACES_SQL = "array<struct<doc:long,mark:long,start:int>>"
CONTENT = f"key long, content binary, least long, reach int, windows int, places {PLACES_SQL}"
CONTENT_ARROW = pa.schema([("key", pa.int64()), ("content", pa.binary()), ("least", pa.int64()), ("reach", pa.int32()), ("windows", pa.int32()), ("places", PLACES)])
SPAN = "doc long, mark long, a int, b int"
SPAN_ARROW = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
WINDOW = f"digest binary, least long, places {PLACES_SQL}"
WINDOW_ARROW = pa.schema([("digest", pa.binary()), ("least", pa.int64()), ("places", PLACES)])


def plain_words(text: bytes) -> bytes:
    """``text`` with words beyond WORD_BYTES as digests."""
    if len(text) <= WORD_BYTES:
        return text
    return LONG_WORD.sub(lambda m: b"\0" + hashlib.blake2b(m[0], digest_size=16).hexdigest().encode(), text)


def pieces(text: bytes, window: int, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Stretches of ``text`` of about ``size`` bytes that together hold every window once: each ends ``window`` - 1 words into the next."""
    at = 0
    tail = re.compile(rb"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){0,%d}" % (window - 1))
    while len(text) - at > size:
        edge = SPACE.search(text, at + size)
        if edge is None:
            break
        yield text[at : tail.match(text, edge.start()).end()]
        at = edge.start()
    yield text[at:]


def runs_of(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, prefix hash, words from the start to the prefix) of maximal runs of windows with one sync point."""
    block = Block(texts, SPACED, lower=False)
    words = block.word_hash()
    n = min(PREFIX, window)
    grams = shingle_hash(words, n)
    if len(grams) <= window - n:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sync = sliding_argmin(grams, window - n + 1)
    at = np.arange(len(sync))
    text = np.searchsorted(block.first, at, "right") - 1
    valid = at + window <= block.first[text + 1]
    edge = np.ones(len(sync), bool)
    edge[1:] = (sync[1:] != sync[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(edge & valid)
    edge[1:] |= ~valid[1:]
    stop = np.append(np.flatnonzero(edge), len(sync))
    count = stop[np.searchsorted(stop, start, "right")] - start
    return text[start], start - block.first[text[start]], count, grams[sync[start]].view(np.int64), sync[start] - start


def packed(start: np.ndarray, windows: np.ndarray, reach: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 16 | windows.astype(np.int64) << 8 | reach.astype(np.int64)


def _groups(order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the values, and where each run of equal ones begins in it."""
    order = np.argsort(order_by, kind="stable")
    edge = np.ones(len(order), bool)
    edge[1:] = order_by[order][1:] != order_by[order][:-1]
    return order, np.flatnonzero(edge)


def _by_document(doc: np.ndarray, mark: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((mark, doc))
    doc, mark, run = doc[order], mark[order], run[order]
    edge = np.ones(len(doc), bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    at = np.flatnonzero(edge)
    runs = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)).astype(np.int32)), pa.array(run))
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(mark[at]), runs], schema=RUNS_ARROW)


def shared_runs(texts: DataFrame, window: int) -> DataFrame:
    """(doc, mark, runs) of texts (doc, mark, text): the runs under prefixes that documents of two ids hold; a document may have several rows."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 20, max(4 * parts, size // BUCKET_BYTES + 1))

    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """What two documents of the slice have is shared and passes by; the rest is asked for, once for a prefix where it passes by."""
        key, doc, mark, run = (np.concatenate(x) for x in zip(*held, strict=True))
        order, at = _groups(key)
        key, doc, mark, run = (x[order] for x in (key, doc, mark, run))
        size = np.diff(np.append(at, len(key)))
        both = np.repeat(np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at), size)
        asks = ~both
        asks[at] = True
        bucket = (key.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
        for open_, chosen in ((True, asks & ~both), (False, asks & both)):
            some = np.flatnonzero(chosen)
            some = some[np.argsort(bucket[some], kind="stable")]
            edges = np.flatnonzero(np.append(True, bucket[some][1:] != bucket[some][:-1])) if len(some) else some
            for a, b in zip(edges, [*edges[1:], len(some)], strict=False):
                one = some[a:b]
                yield record(BLOB_ARROW, bucket=[int(bucket[one[0]])], open=[open_], **{n: [x[one].tobytes()] for n, x in (("key", key), ("doc", doc), ("mark", mark), ("run", run))})
        some = np.flatnonzero(both)
        for lo in range(0, len(some), 4096):
            one = some[lo : lo + 4096]
            yield record(BLOB_ARROW, bucket=[int(bucket[one[0]])], open=[False], key=[b""], **{n: [x[one].tobytes()] for n, x in (("doc", doc), ("mark", mark), ("run", run))})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        held: list[tuple[np.ndarray, ...]] = []
        total, seen = 0, set()
        block: list[bytes] = []
        of: list[tuple[int, int, int]] = []

        def scanned() -> None:
            nonlocal total
            text, start, n, key, reach = runs_of(block, window)
            doc, mark, before = (np.array([x[k] for x in of], np.int64)[text] for k in range(3))
            held.append((key, doc, mark, packed(start + before, n, reach)))
            total += len(key)
            block.clear()
            of.clear()

        room = 0
        for batch in batches:
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                if (doc, mark) in seen:
                    continue
                seen.add((doc, mark))
                before = 0
                for piece in pieces(plain_words(text.as_py() or b""), window, BLOCK_BYTES):
                    block.append(piece)
                    of.append((doc, mark, before))
                    room += len(piece)
                    if room >= BLOCK_BYTES or len(block) >= 4096:
                        scanned()
                        room = 0
                        if total >= SLICE:
                            yield from send(held)
                            held, total, seen = [], 0, set()
                    before += len(piece.split()) - (window - 1)
        if block:
            scanned()
        if total:
            yield from send(held)

    def answer(blobs: list[tuple]) -> pa.RecordBatch:
        asked = [b for b in blobs if b[1]]
        key, doc, mark, run = (np.concatenate([np.frombuffer(b[k], np.int64) for b in asked]) for k in range(1, 5))
        open_ = np.repeat([b[5] for b in asked], [len(b[1]) // 8 for b in asked])
        order, at = _groups(key)
        key, doc, mark, run, open_ = (x[order] for x in (key, doc, mark, run, open_))
        size = np.diff(np.append(at, len(key)))
        shared = (np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)) | ~np.minimum.reduceat(open_, at)
        mine = np.flatnonzero(np.repeat(shared, size) & open_)
        return _by_document(doc[mine], mark[mine], run[mine])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        bucket, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                blob = tuple(batch.column(k)[r].as_py() for k in range(6))
                if not blob[1]:
                    yield _by_document(*(np.frombuffer(blob[k], np.int64) for k in (2, 3, 4)))
                    continue
                if blob[0] != bucket and held:
                    yield answer(held)
                    held = []
                bucket = blob[0]
                held.append(blob)
        if held:
            yield answer(held)

    blobs = texts.select("doc", "mark", "text").mapInArrow(scan, BLOB)
    return blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, RUNS)


def contents(texts: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """The shared runs' words by slice of the scan: one row for each content, with the places of its smallest doc_id.

    Rows without a content are places that a smaller doc_id of the slice repeats.
    """
    each = shared.groupBy("doc", "mark").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    def send(held: dict[tuple[int, bytes], list]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f: [] for f in CONTENT_ARROW.names}

        def put(*values: object) -> None:
            for column, v in zip(out.values(), values, strict=True):
                column.append(v)

        for (_, content), (reach, windows, key, places) in held.items():
            least = min(p[0] for p in places)
            first = [p for p in places if p[0] == least]
            put(key, content, least, reach, windows, [dict(zip(("doc", "mark", "start"), p, strict=True)) for p in first])
            if len(first) < len(places):
                put(None, None, None, None, windows, [dict(zip(("doc", "mark", "start"), p, strict=True)) for p in places if p[0] > least])
        for lo in range(0, len(out["key"]), 2048):
            yield record(CONTENT_ARROW, **{k: v[lo : lo + 2048] for k, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        held: dict[tuple[int, bytes], list] = {}
        total = 0
        for batch in batches:
            for doc, mark, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), batch.column(3), strict=True):
                runs = np.unique(runs.values.to_numpy())
                words = plain_words(text.as_py()).split()
                for start, n, reach in zip((runs >> 16).tolist(), (runs >> 8 & 0xFF).tolist(), (runs & 0xFF).tolist(), strict=True):
                    content = b" ".join(words[start : start + n + window - 1])
                    found = held.get((reach, content))
                    if found is None:
                        prefix = hashlib.blake2b(b" ".join(words[start + reach : start + reach + PREFIX]), digest_size=8).digest()
                        found = held[reach, content] = [reach, n, int.from_bytes(prefix, "little", signed=True), []]
                    found[3].append((doc, mark, start))
                total += len(runs)
                if total >= CONTENTS:
                    yield from send(held)
                    held, total = {}, 0
        if held:
            yield from send(held)

    return texts.join(each, ["doc", "mark"]).select("doc", "mark", "text", "runs").mapInArrow(run, CONTENT)


class SuffixTree:
    """The suffix tree over given suffixes, as rows of symbols (padded with -1 behind their ends).

    Leaves are in lexical order; a node is (depth, first leaf, last leaf + 1, parent), node 0 the root.
    """

    def __init__(self, suffixes: np.ndarray) -> None:
        n, width = suffixes.shape
        wide = np.ascontiguousarray((suffixes + 1).astype(">u4"))
        self.order = np.argsort(wide.view(f"V{4 * width}").ravel(), kind="stable")
        rows = suffixes[self.order]
        same = (rows[1:] == rows[:-1]) & (rows[1:] >= 0)
        lcp = np.where(same.all(1), width, same.argmin(1)) if n > 1 else np.zeros(0, np.int64)
        depth, first, last, parent = [0], [0], [n], [-1]
        path = [0]
        for i, x in enumerate(lcp.tolist()):
            low = i
            above = -1
            while depth[path[-1]] > x:
                above = path.pop()
                last[above] = i + 1
                low = first[above]
            if depth[path[-1]] < x:
                node = len(depth)
                depth.append(x)
                first.append(low)
                last.append(n)
                parent.append(path[-1])
                path.append(node)
            if above >= 0:
                parent[above] = path[-1]
        self.depth, self.first, self.last, self.parent = (np.array(v, np.int64) for v in (depth, first, last, parent))

    def deep(self, depth: int) -> np.ndarray:
        """The topmost internal nodes of at least that depth, in the order of their leaves."""
        at = np.flatnonzero((self.depth >= depth) & (self.depth[self.parent] < depth))
        return at[np.argsort(self.first[at])]


def repeated(members: list[tuple[int, bytes, int, int]], window: int) -> list[np.ndarray]:
    """For members (prefix, content, smallest doc_id, windows): which of the windows start under a smaller doc_id too."""
    number: dict[bytes, int] = {}
    prefix: dict[int, int] = {}
    words = [[number.setdefault(w, len(number)) for w in m[1].split(b" ")] for m in members]
    count = np.array([m[3] for m in members], np.int64)
    width = int(max(map(len, words)))
    text = np.full((len(words), 2 * width), -1, np.int64)
    for row, w in zip(text, words, strict=True):
        row[: len(w)] = w
    of = np.repeat(np.arange(len(members)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    lead = np.array([prefix.setdefault(m[0], len(prefix)) for m in members], np.int64)[of]
    suffixes = np.concatenate([lead[:, None], text[of[:, None], at[:, None] + np.arange(width)]], 1)
    tree = SuffixTree(suffixes)
    doc = np.array([m[2] for m in members], np.int64)[of][tree.order]
    hit = np.zeros(len(of), bool)
    deep = tree.deep(window + 1)
    for a, b in zip(tree.first[deep].tolist(), tree.last[deep].tolist(), strict=True):
        hit[tree.order[a:b]] = doc[a:b] > doc[a:b].min()
    return np.split(hit, np.cumsum(count)[:-1])


def _stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of true values."""
    step = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def _from_trees(runs: DataFrame, window: int) -> DataFrame:
    def solve(unit: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        for r, hit in zip(unit, repeated([(r[0], r[1], r[2], r[4]) for r in unit], window), strict=True):
            if hit.any():
                lo, hi = _stretches(hit)
                out += [(p["doc"], p["mark"], p["start"] + a, p["start"] + b + window) for p in r[5] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        return record(SPAN_ARROW, **{f: [x[k] for x in out] for k, f in enumerate(SPAN_ARROW.names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        unit: list[tuple] = []
        group: list[tuple] = []
        leaves = 0

        def closed() -> None:
            """A prefix that one content alone has shares nothing."""
            nonlocal leaves
            if len(group) > 1:
                unit.extend(group)
                leaves += sum(r[4] for r in group)
            group.clear()

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and r[0] != group[0][0]:
                    closed()
                    if leaves >= LEAVES:
                        yield solve(unit)
                        unit, leaves = [], 0
                group.append(r)
        closed()
        if unit:
            yield solve(unit)

    names = CONTENT_ARROW.names
    return runs.select(*names).repartition("key").sortWithinPartitions("key").mapInArrow(run, SPAN)


def _from_windows(runs: DataFrame, window: int) -> DataFrame:
    """Windows under frequent prefixes, grouped by all their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f: [] for f in WINDOW_ARROW.names}
            for content, least, n, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = content.split(b" ")
                for j in range(n):
                    digest = hashlib.blake2b(b" ".join(words[j : j + window]), digest_size=16).digest()
                    for f, v in zip(out.values(), (digest, least, [p | {"start": p["start"] + j} for p in places]), strict=True):
                        f.append(v)
            yield record(WINDOW_ARROW, **out)

    each = cut(runs.select("content", "least", "windows", "places").mapInArrow(run, WINDOW), "windows")
    least = each.groupBy("digest").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last")
    later = each.join(least.drop("last"), "digest").where("least > first")
    return later.select(F.explode("places").alias("p")).selectExpr("p.doc", "p.mark", "p.start as a", f"p.start + {window} as b")


def passages(texts: DataFrame, window: int = 13) -> DataFrame:
    """(doc, mark, a, b): word spans, possibly overlapping, of texts (doc, mark, text) that together cover what smaller docs repeat."""
    runs = cut(contents(texts, shared_runs(texts, window), window), "contents")
    spans = runs.where("content is null").select("windows", F.explode("places").alias("p")).selectExpr("p.doc", "p.mark", "p.start as a", f"p.start + windows - 1 + {window} as b")
    runs = runs.where("content is not null")
    large = cut(runs.groupBy("key").agg(F.count("*").alias("members")).where(f"members > {MEMBERS}").select("key"), "large")
    if large.isEmpty():
        return spans.unionByName(_from_trees(runs, window))
    spans = spans.unionByName(_from_trees(runs.join(large, "key", "left_anti"), window))
    return spans.unionByName(_from_windows(runs.join(large, "key", "left_semi"), window))


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    """(row, text, spans) for every row of ``docs``; ``spans`` is null where nothing is repeated."""
    rows = named(small_batches(docs), "text").withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    texts = rows.select("doc", "mark", "text").where("text is not null")
    spans = settled(lambda: passages(texts, window).groupBy("doc", "mark").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    return rows.join(spans, ["doc", "mark"], "left").select("row", "text", "spans")


def kept_words(text: bytes, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """Words that are left, and the number of all words."""
    words = text.split()
    kept, upto = [], 0
    for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
        kept += words[upto:a]
        upto = max(upto, b)
    return kept + words[upto:], len(words)


def _mapped(found: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                yield each(batch.slice(lo, 256))

    return found.mapInArrow(run, schema)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def dedup_passages(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``; the digest is of the kept words joined by one space.

    A null text has no words, and texts below ``window`` words lose none. A null
    doc_id comes after all others (like the largest long), so its row loses what
    any document with an id holds and takes nothing from others. Rows of one
    doc_id, repeated rows included, take nothing from each other. Other columns
    are ignored; an empty table gives no rows.
    """
    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f: [] for f in RESULT_ARROW.names}
        for doc, text, spans in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()), part.column(2).to_pylist(), strict=True):
            kept, n = kept_words(text.as_py() or b"", spans)
            for f, v in zip(out.values(), (doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                f.append(v)
        return record(RESULT_ARROW, **out)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _mapped(_with_spans(docs, window).select("row.doc_id", "text", "spans"), each, RESULT)


def without_passages(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs``, all rows and columns; a text that loses words becomes its other words joined by one space, and others stay as they are.

    Rows are told apart as in :func:`dedup_passages`; a null text stays null.
    """
    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
        kept = [b" ".join(kept_words(t.encode(), s)[0]).decode() if s else t for t, s in texts]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string())], names=["row", "text"])

    found = _with_spans(docs, window)
    schema = StructType([found.schema["row"], StructField("text", StringType())])
    return unpacked(_mapped(found, each, schema), docs.columns, "text")


def oracle_sql(window: int = 13) -> str:
    """The rows of :func:`dedup_passages` over ``documents``, in DuckDB SQL."""
    return rf"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS doc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT r, doc, i, md5_number(array_to_string(list_slice(w, i, i + {window - 1}), ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - {window - 2})) AS i FROM t WHERE len(w) >= {window})),
f AS (SELECT k, min(doc) AS least FROM g GROUP BY k),
x AS (SELECT r, list_distinct(flatten(list(range(i, i + {window})))) AS gone FROM g JOIN f USING (k) WHERE least < doc GROUP BY r),
y AS (SELECT t.r, doc_id, len(w) AS n, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda e, i: NOT list_contains(gone, i)) END AS kept FROM t LEFT JOIN x USING (r))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM y"""
