"""Quality rules with an n-gram perplexity band for each language.

The language model is modified Kneser-Ney over the bytes of words: a word is
its lower-cased bytes between two spaces, and its n-grams never reach beyond
it. (Word n-grams are no choice here: their table cannot be broadcast, and
looking it up by a join shuffles every word of every document, several times
the input; the n-grams of words are few and still follow the corpus.) Spark
counts the highest order over all documents, derives the lower orders'
continuation counts, discounts and back-off weights by grouping, all over
every n-gram.

The documents that are scored are those that were counted, so each n-gram in
them has a probability of its own, and scoring looks that up. The table of
probabilities goes out in shards of about ``SHARD_GRAMS`` n-grams, with a pass
over the documents for each, and the passes' sums are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut, settled
from tessera.llm.scan import LOWER, mix, record, small_batches, text_blocks
from tessera.llm.stats import Stats

ORDER = 5
#: N-grams in a broadcast shard, 12 bytes each.
SHARD_GRAMS = 4_000_000
#: Larger blocks share more words, each of which is scored once a block.
BLOCK = 1 << 21
#: Quartile ranges outside the middle half that a document's log-perplexity may lie.
SPREAD = 3.0
SPACE = 32
U64 = np.uint64


def padded_words(stats: Stats, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given words, each between two spaces, and where each begins (with the end)."""
    b = stats.block
    size = b.end[words] - b.start[words] + 2
    first = np.append(0, np.cumsum(size))
    out = np.full(first[-1], SPACE, np.uint8)
    inner = np.ones(len(out), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    step = np.arange(len(out)) - np.repeat(first[:-1], size) - 1
    src = np.repeat(b.start[words], size) + step
    out[inner] = LOWER[b.buf[src[inner]]]
    return out, first


def grams(text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte but a word's first: the n-gram that ends there as a number, and its order (at most ORDER)."""
    at = np.arange(len(text)) - np.repeat(first[:-1], np.diff(first))
    order = np.minimum(at + 1, ORDER)
    key = np.zeros(len(text), np.uint64)
    for j in range(ORDER - 1, -1, -1):
        byte = np.zeros(len(text), np.uint64)
        byte[j:] = text[: len(text) - j] if j else text
        key = (key << U64(8)) | np.where(at >= j, byte, U64(0))
    return key, order


def word_types(stats: Stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct word of the block, the type of every word, and how often each type occurs."""
    _, place, which, count = np.unique(stats.word_hash, return_index=True, return_inverse=True, return_counts=True)
    return place, which, count


def counts(docs: DataFrame) -> DataFrame:
    """(order, key, c): n-grams of the highest order, and shorter ones that begin a word, over all documents."""
    schema = pa.schema([("order", pa.int32()), ("key", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers = [], []

        def close() -> pa.RecordBatch:
            k = np.concatenate(keys)
            key, which = np.unique(k, return_inverse=True)
            c = np.bincount(which, np.concatenate(numbers)).astype(np.int64)
            low = key & U64((1 << 56) - 1)
            return record(schema, order=(key >> U64(56)).astype(np.int32), key=low.view(np.int64), c=c)

        for _, texts in text_blocks(batches, size=BLOCK):
            stats = Stats(texts)
            if not len(stats.word_hash):
                continue
            place, _, count = word_types(stats)
            text, first = padded_words(stats, place)
            key, order = grams(text, first)
            ok = order > 1
            key = (key | (order.astype(np.uint64) << U64(56)))[ok]
            kind, which = np.unique(key, return_inverse=True)
            keys.append(kind)
            numbers.append(np.bincount(which, np.repeat(count, np.diff(first))[ok]))
            if sum(map(len, keys)) > 4_000_000:
                batch = close()
                keys, numbers = [batch.column(1).to_numpy().view(np.uint64) | (batch.column(0).to_numpy().astype(np.uint64) << U64(56))], [batch.column(2).to_numpy()]
        if keys:
            yield close()

    out = small_batches(docs).select("text").mapInArrow(run, "order int, key long, c long")
    return out.groupBy("order", "key").agg(F.sum("c").alias("c"))


@dataclass
class KneserNey:
    """Log-probabilities and back-off weights in arrays sorted by hashed n-gram."""

    gram: list[np.ndarray]
    logp: list[np.ndarray]
    context: list[np.ndarray]
    backoff: list[np.ndarray]

    def score(self, key: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Log-probability of the last byte of each n-gram given the bytes before it."""
        out = np.zeros(len(key))
        todo = np.arange(len(key))
        for n in range(ORDER, 0, -1):
            mine = todo[order[todo] >= n]
            later = todo[order[todo] < n]
            k = key[mine] & U64((1 << (8 * n)) - 1)
            hit, at = _find(self.gram[n], hashed(k, n))
            out[mine[hit]] += self.logp[n][at[hit]]
            missed, k = mine[~hit], k[~hit]
            if n > 1:
                known, at = _find(self.context[n], hashed(k >> U64(8), n))
                out[missed[known]] += self.backoff[n][at[known]]
            else:
                out[missed] += self.backoff[1][0] if len(self.backoff[1]) else -np.log(256)
            todo = np.concatenate([missed, later])
        return out


def hashed(key: np.ndarray, order: int) -> np.ndarray:
    return mix(key + U64(order * 0x9E3779B97F4A7C15 % 2**64))


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return table[at] == key, at


def tables(raw: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 on, (key, p) of all its n-grams and (context, gamma) of all its contexts, as written tables."""
    upper = None
    grams_of = {}
    for n in range(ORDER, 0, -1):
        c = raw.where(F.col("order") == n).select("key", "c")
        if upper is not None:  # how many different bytes precede; word beginnings keep their counts
            low = (1 << (8 * n)) - 1
            c = c.unionByName(upper.select(F.col("key").bitwiseAND(F.lit(low)).alias("key")).groupBy("key").agg(F.count("*").alias("c")))
            c = c.groupBy("key").agg(F.sum("c").alias("c"))
        grams_of[n] = upper = cut(c.withColumn("context", F.shiftright("key", 8)), f"grams{n}")
    out = []
    for n in range(1, ORDER + 1):
        t = grams_of[n]
        of = {r["k"]: r["n"] for r in t.where("c <= 4").groupBy(F.col("c").alias("k")).agg(F.count("*").alias("n")).collect()}
        d = _discounts(of)
        own = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        t = t.withColumn("left", F.greatest(F.col("c") - own, F.lit(0.0)))
        given = t.groupBy("context").agg(F.sum("left").alias("given"), F.sum("c").alias("total"))
        given = cut(given.withColumn("gamma", F.greatest(1 - F.col("given") / F.col("total"), F.lit(1e-9))), f"contexts{n}")
        p = t.join(given.select("context", "total", "gamma"), "context")
        if not out:
            p = p.withColumn("p", F.col("left") / F.col("total") + F.col("gamma") / 256)
        else:
            low = (1 << (8 * (n - 1))) - 1
            p = p.withColumn("suffix", F.col("key").bitwiseAND(F.lit(low))).join(out[-1][0].select(F.col("key").alias("suffix"), F.col("p").alias("q")), "suffix", "left")
            p = p.withColumn("p", F.col("left") / F.col("total") + F.col("gamma") * F.coalesce("q", F.lit(1e-7)))
        out.append((cut(p.select("key", "p"), f"p{n}"), given.select("context", "gamma")))
    return out


def kneser_ney(raw: DataFrame) -> KneserNey:
    """The whole model in the driver's memory, for texts that were not counted; quality_rules does not gather it."""
    model = KneserNey(*([np.zeros(0)] * (ORDER + 1) for _ in range(4)))
    for n, (p, given) in enumerate(tables(raw), 1):
        model.gram[n], model.logp[n] = _arrays(p.toArrow(), n)
        model.context[n], model.backoff[n] = _arrays(given.toArrow(), n)
        if n == 1 and len(model.backoff[1]):
            model.backoff[1] = model.backoff[1] - np.float32(np.log(256))
    return model


def probabilities(raw: DataFrame) -> DataFrame:
    """(gram, p) of every n-gram that ``counts`` finds; ``gram`` has the order above the bytes."""
    of = [p.select(F.lit(n).alias("order"), "key", "p") for n, (p, _) in enumerate(tables(raw), 1) if n > 1]
    every = of[0]
    for p in of[1:]:
        every = every.unionByName(p)
    begins = F.expr(f"order = {ORDER} or shiftright(key, 8 * (order - 1)) = {SPACE}")  # shorter ones begin a word
    return every.where(begins).select(F.col("key").bitwiseOR(F.shiftleft(F.col("order").cast("long"), 56)).alias("gram"), "p")


@dataclass
class Shard:
    """Log-probabilities of some n-grams, in arrays sorted by n-gram."""

    gram: np.ndarray
    logp: np.ndarray

    def score(self, key: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Log-probability of the last byte of each n-gram of this shard, 0 for those of other shards."""
        hit, at = _find(self.gram, key | (order.astype(np.uint64) << U64(56)))
        return np.where(hit, self.logp[at] if len(self.gram) else 0.0, 0.0)


def shards(raw: DataFrame) -> Iterator[tuple[int, int, Shard]]:
    """(number, how many in all, shard): the n-grams of a shard are those of a range of hashes, about SHARD_GRAMS."""
    every = settled(lambda: probabilities(cut(raw, "counts")), "probabilities")
    n = max(1, -(-every.count() // SHARD_GRAMS))
    for k in range(n):
        t = every.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == k).toArrow()
        gram = t.column(0).to_numpy().astype(np.int64).view(np.uint64)
        by = np.argsort(gram)
        yield k, n, Shard(gram[by], np.log(t.column(1).to_numpy()[by]).astype(np.float32))


def _discounts(of: dict[int, int]) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts of one, two and more."""
    n1, n2, n3, n4 = (of.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(float(min(max(d, 0.05), k)) for k, d in ((0.95, 1 - 2 * y * n2 / n1), (1.9, 2 - 3 * y * n3 / n2), (2.9, 3 - 4 * y * n4 / n3)))


def _arrays(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    key = hashed(table.column(0).to_numpy().astype(np.int64).view(np.uint64), order)
    by = np.argsort(key)
    return key[by], np.log(table.column(1).to_numpy()[by]).astype(np.float32)


#: Bins of a unit of log-perplexity in which quartiles are counted.
BINS = 1 << 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_scored")
RULES = "row long, doc_id long, lang string, " + ", ".join(f"{f} long" for f in COUNTS) + ", logp double"
RULES_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), *((f, pa.int64()) for f in COUNTS), ("logp", pa.float64())])


def measure(docs: DataFrame, shard: Shard) -> DataFrame:
    """For rows (row, doc_id, lang, text) the counts of the rules, how many bytes are scored, and the sum of what ``shard`` knows of their log-probabilities."""
    held = docs.sparkSession.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, size=BLOCK):
            s = Stats(texts)
            n = len(texts)
            total, size = np.zeros(n), np.zeros(n, np.int64)
            if len(s.word_hash):
                place, which, _ = word_types(s)
                text, first = padded_words(s, place)
                key, order = grams(text, first)
                ok = order > 1
                logp = np.zeros(len(key))
                logp[ok] = held.value.score(key[ok], order[ok])
                of_type = np.add.reduceat(logp, first[:-1])
                total = np.bincount(s.word_doc, of_type[which], n)
                size = np.bincount(s.word_doc, (np.diff(first) - 1)[which], n).astype(np.int64)
            yield record(RULES_ARROW, row=batch.column(0), doc_id=batch.column(1), lang=batch.column(2), n_words=s.n_words, word_chars=s.word_chars, n_symbols=s.n_symbols, n_dup_lines=s.n_dup_lines, n_repeat_words=s.n_repeat_words, n_scored=size, logp=total)

    return docs.mapInArrow(run, RULES)


def measured(docs: DataFrame) -> DataFrame:
    """The counts of the rules for every row of ``docs`` and the mean negative log-probability of a byte, null without words."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text")
    rows, sums = None, []
    for k, n, shard in shards(counts(docs)):
        if k == 0 and n > 1:  # the passes' sums meet by row
            own = cut(own.withColumn("row", F.monotonically_increasing_id()), "numbered")
        if k == 0:
            rows = cut(measure(own, shard), "measured")
        else:
            sums.append(cut(measure(own, shard).select("row", "logp"), "measured"))
    if sums:
        every = rows.select("row", "logp")
        for s in sums:
            every = every.unionByName(s)
        rows = cut(rows.drop("logp").join(every.groupBy("row").agg(F.sum("logp").alias("logp")), "row"), "summed")
    return rows.withColumn("log_perplexity", F.expr("case when n_scored > 0 then -logp / n_scored end")).drop("row", "n_scored", "logp")


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, log_perplexity, kept) for every row of ``docs``.

    A document fails the base rules with fewer than 50 words or where more than
    half its words stand in 3-word windows found twice or more. Of the others
    those stay whose log-perplexity lies within SPREAD quartile ranges around
    the middle half of their language (documents that pass the base rules).

    A null or empty text has no words and fails. Rows without a language are a
    language of their own. Repeated rows are counted as often as they occur;
    null doc_ids are judged like others; an empty table gives no rows.
    """
    rows = measured(docs)
    rows = rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    # counted in narrow bins, so that no order of merging shows in the quartiles
    bins = rows.where("not base_failed and log_perplexity is not null").groupBy(F.col("lang").alias("_lang"), F.floor(F.col("log_perplexity") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.min("log_perplexity").alias("least"))
    bins = bins.select("_lang", "least", F.expr("sum(n) over (partition by _lang order by bin)").alias("upto"), F.expr("sum(n) over (partition by _lang)").alias("all"))
    quarter = [F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * part), F.col("least"))) for part in (0.25, 0.75)]
    band = bins.groupBy("_lang").agg(F.array(*quarter).alias("q")).select("_lang", F.expr(f"q[0] - {SPREAD} * greatest(q[1] - q[0], 0.01)").alias("low"), F.expr(f"q[1] + {SPREAD} * greatest(q[1] - q[0], 0.01)").alias("high"))
    out = rows.join(band, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", (~F.col("base_failed") & inside).alias("kept"))
