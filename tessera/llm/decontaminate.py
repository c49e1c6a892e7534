"""Benchmark windows in documents, by a prefix-filtered set join.

An item's windows are its runs of ``window`` consecutive words; an item of
fewer words is one window. A window is found through one *prefix* shingle of
``SHINGLE`` words: as the whole window has to occur, the rarest of its shingles
is prefix enough, and the order of shingles by rarity is counted on the
documents themselves. A document shingle that is some window's prefix gives a
candidate; the shingle's place in the window fixes where the window would
begin, and candidates that would begin before the document or end after it are
dropped (positional and length bounds). What is left is compared word by word
over the window.

The windows are the stated queries: they go to the tasks in blocks of at most
``BLOCK_WINDOWS``, with their words and a number each, so what is broadcast has a
fixed bound however large the benchmark is and however many items share a
window. Texts are never shuffled; what was found in them is joined with the items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.llm.rows import named, packed, unpacked
from tessera.llm.scan import ALNUM, Block, record, shingle_hash, small_batches, text_blocks

SHINGLE = 4
#: Windows broadcast at a time, at some 100 bytes each.
BLOCK_WINDOWS = 200_000

WINDOW_ARROW = pa.schema([("item_id", pa.string()), ("window", pa.string()), ("keys", pa.list_(pa.int64()))])


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, window, keys): each distinct window of an item as space-joined words, with its shingles' hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            block = Block(texts, ALNUM, lower=True)
            words = block.word_hash()
            out: dict[str, list] = {f.name: [] for f in WINDOW_ARROW}
            for k, item in enumerate(batch.column(0).to_pylist()):
                a, b = int(block.first[k]), int(block.first[k + 1])
                seen = set()
                for s in range(a, max(b - window, a) + 1) if b > a else ():
                    e = min(s + window, b)
                    text = b" ".join(block.buf[i:j].tobytes() for i, j in zip(block.start[s:e], block.end[s:e], strict=True)).decode()
                    if text not in seen:
                        seen.add(text)
                        keys = shingle_hash(words[s:e], min(SHINGLE, e - s)).view(np.int64)
                        for f, v in zip(out.values(), (item, text, keys.tolist()), strict=True):
                            f.append(v)
            yield record(WINDOW_ARROW, **out)

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item_id string, window string, keys array<long>")


def _shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles inside documents, and the word each begins with."""
    grams = shingle_hash(words, n)
    at = np.arange(len(grams))
    last = first[np.searchsorted(first, at, "right")]
    ok = at + n <= last
    return grams[ok], at[ok]


def shingle_counts(docs: DataFrame, keys: np.ndarray, sizes: list[int]) -> DataFrame:
    """(key, n): occurrences in ``docs`` of the given shingle hashes."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(np.sort(keys.view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        total = np.zeros(len(table), np.int64)
        for _, texts in text_blocks(batches):
            block = Block(texts, ALNUM, lower=True)
            words = block.word_hash()
            for n in sizes:
                grams, _ = _shingles(words, block.first, n)
                k = np.searchsorted(table, grams)
                k[k == len(table)] = 0
                total += np.bincount(k[table[k] == grams], minlength=len(table))
        used = np.flatnonzero(total)
        yield record(schema, key=table[used].view(np.int64), n=total[used])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Windows:
    """A block of windows by prefix shingle."""

    def __init__(self, windows: list[bytes], numbers: list[int], keys: list[np.ndarray], counts: dict[int, int]) -> None:
        self.words = [w.split(b" ") for w in windows]
        self.number = np.array(numbers, np.int64)
        place = [min(range(len(k)), key=lambda i: (counts.get(int(k[i]), 0), i)) for k in keys]
        prefix = np.array([k[p] for k, p in zip(keys, place, strict=True)], np.int64).view(np.uint64)
        order = np.argsort(prefix, kind="stable")
        self.key, self.window, self.place = prefix[order], order, np.array(place, np.int64)[order]
        self.size = np.array([len(w) for w in self.words], np.int64)[order]
        self.shingle = sorted({min(SHINGLE, int(n)) for n in self.size})

    def occurrences(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, size, window) of every occurrence in the block's documents."""
        words = block.word_hash()
        found: list[tuple[int, int, int]] = []
        for n in self.shingle:
            grams, at = _shingles(words, block.first, n)
            lo = np.searchsorted(self.key, grams)
            hit = np.flatnonzero(self.key[np.minimum(lo, len(self.key) - 1)] == grams)
            for g in hit:
                k = int(lo[g])
                doc = int(np.searchsorted(block.first, at[g], "right")) - 1
                while k < len(self.key) and self.key[k] == grams[g]:
                    s, size = int(at[g] - self.place[k]), int(self.size[k])
                    if s >= block.first[doc] and s + size <= block.first[doc + 1] and min(SHINGLE, size) == n:
                        want = self.words[self.window[k]]
                        if all(block.buf[block.start[s + i] : block.end[s + i]].tobytes() == want[i] for i in range(size)):
                            found.append((s, size, int(self.window[k])))
                    k += 1
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)


HIT = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64()))])


def _scan(rows: DataFrame, windows: Windows) -> DataFrame:
    """(doc, mark, doc_id, n_words, hits, windows): first and last word of each maximal hit run, and the windows found."""
    held = rows.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            block = Block(texts, ALNUM, lower=True)
            hits: list[list[int]] = [[] for _ in texts]
            found: list[set[int]] = [set() for _ in texts]
            start, size, window = held.value.occurrences(block)
            order = np.argsort(start, kind="stable")
            for s, n, w in zip(start[order].tolist(), size[order].tolist(), held.value.number[window[order]].tolist(), strict=True):
                doc = int(np.searchsorted(block.first, s, "right")) - 1
                s -= int(block.first[doc])
                run_ = hits[doc]
                if run_ and s <= run_[-1]:
                    run_[-1] = max(run_[-1], s + n)
                else:
                    run_ += [s, s + n]
                found[doc].add(w)
            own = dict(zip(("doc", "mark", "doc_id"), batch.columns, strict=False))
            yield record(HIT, **own, n_words=block.n_words, hits=hits, windows=[sorted(x) for x in found])

    return rows.select("doc", "mark", "doc_id", "text").mapInArrow(run, "doc long, mark long, doc_id long, n_words long, hits array<int>, windows array<long>")


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    Words are runs of ASCII letters and digits and of all non-ASCII bytes, A-Z
    lower-cased. n_hit counts the words of a document inside any occurrence of
    a window; n_items the items with an occurring window, whose ids make
    items_sha256 (sorted as strings, comma-joined).

    A null or empty text has no words and no hits; an item without words has no
    window; a null item_id counts as the empty string. Repeated documents and
    repeated items are judged as they stand (an item_id counts once); rows
    without a doc_id or with a shared one have their own hits. Other columns
    are ignored. No items, or no documents, give no hits, or no rows.
    """
    rows = named(docs.select("doc_id", "text"))
    of_items, blocks = _window_blocks(docs, items, window)
    every, found = None, None
    for windows in blocks:
        part = _scan(rows, windows)
        if every is None:
            every = found = cut(part, "scanned")
        else:
            found = found.unionByName(cut(part.where("size(hits) > 0"), "scanned"))
    found = found.where("size(hits) > 0")
    runs = found.groupBy("doc", "mark").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    ids = found.select("doc", "mark", F.explode("windows").alias("number")).distinct().join(of_items, "number").groupBy("doc", "mark").agg(F.collect_set("item_id").alias("items"))
    out = every.drop("hits").join(runs.join(ids, ["doc", "mark"]), ["doc", "mark"], "left").select("doc_id", "n_words", "hits", "items")
    return out.mapInArrow(_summary, RESULT)


def without_benchmark(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item window occurs: passes over the table and no shuffle."""
    rows = packed(docs, "text")
    for windows in _window_blocks(docs, items, window)[1]:
        held = docs.sparkSession.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_blocks(batches):
                block = Block(texts, ALNUM, lower=True)
                start, _, _ = held.value.occurrences(block)
                hit = np.zeros(len(texts), bool)
                hit[np.searchsorted(block.first, start, "right") - 1] = True
                yield batch.filter(pa.array(~hit))

        rows = rows.mapInArrow(run, rows.schema)
    return unpacked(rows, docs.columns)


def _window_blocks(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, Iterator[Windows]]:
    """(number, item_id) of the items' windows, and the windows, at most about BLOCK_WINDOWS at a time, with prefixes chosen by counts over ``docs``."""
    each = cut(item_windows(small_batches(items), window), "item-windows")
    windows = each.select("window", "keys").distinct().withColumn("number", F.monotonically_increasing_id())
    windows = cut(windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(1 << 20))), "windows")
    n = max(1, -(-windows.count() // (BLOCK_WINDOWS // 2)))

    def blocks() -> Iterator[Windows]:
        for k in range(n):
            rows = windows.where(F.col("block") % n == k).orderBy("window").collect()
            keys = [np.array(r["keys"], np.int64) for r in rows]
            flat = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]))
            sizes = sorted({min(SHINGLE, r["window"].count(" ") + 1) for r in rows})
            counts = {r["key"]: r["n"] for r in shingle_counts(docs, flat, sizes).collect()} if rows else {}
            yield Windows([r["window"].encode() for r in rows], [r["number"] for r in rows], keys, counts)

    of_items = each.join(windows.select("window", "number"), "window").select("number", F.coalesce("item_id", F.lit("")).alias("item_id")).distinct()
    return of_items, blocks()


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, digest = [], [], []
        for hits, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            n, upto = 0, 0
            for s, e in sorted(zip((hits or [])[::2], (hits or [])[1::2], strict=True)):
                n += max(0, e - max(s, upto))
                upto = max(upto, e)
            n_hit.append(n)
            n_items.append(len(items or ()))
            digest.append(hashlib.sha256(",".join(sorted(items or ())).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def oracle_sql() -> str:
    """The rows of :func:`decontaminate` over ``documents`` and ``benchmark`` with windows of ten words, in DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN sizes ON len(w) >= n)),
hit AS (SELECT rid, k, n, item_id FROM dw JOIN iw USING (win, n)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT rid, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS s FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN words USING (rid) LEFT JOIN ids USING (rid)"""
