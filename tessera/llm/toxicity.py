"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of two rows of a hashed embedding table, so two words agree
only where both hashes do. Filters of several widths run over the words, each
keeps its largest activation in the document (max pooling), and a logistic unit
weighs those. Because a filter is linear, its response to each table row is
kept ready, and scoring is a few gathers per word.

Training runs on a bounded sample of labelled rows, in the driver; each
gradient reaches only the words that won a pooling. A part of the sample is held
back to calibrate the score (Platt). The rejection threshold of each language comes
from all labelled rows that were not trained on, counted by score in Spark.
Language is no input of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.cut import cut
from tessera.llm.labelled import labelled, remainder, training_labels
from tessera.llm.rows import packed, unpacked
from tessera.llm.scan import ALNUM, Block, record, small_batches, text_blocks, trim

TABLE_BITS = 15
WIDTHS = (1, 2, 3)
FILTERS = 12
DIM = 12
#: The most labelled rows of either label that the model is fitted on.
SAMPLE_ROWS = 5000
#: The most words of that sample, four bytes each in the driver; rows that no longer fit are left out, in the order of their ids' hashes.
SAMPLE_WORDS = 6_000_000
STEPS = 800
BATCH = 64
#: A word trains its table rows only if it stands in so many documents of the sample; the rest are blanks.
LEAST_DOCUMENTS = 3
#: Part of the sample that calibrates instead of training.
HELD_BACK = 5
#: A language with fewer labelled rows of either label, trained rows aside, takes the common threshold.
LEAST_ROWS = 20


def word_slots(block: Block) -> np.ndarray:
    """(words, 2) table rows of the block's words."""
    h = block.word_hash()
    low = np.uint64((1 << TABLE_BITS) - 1)
    first = (h & low).astype(np.int32)
    second = ((h >> np.uint64(32)) & low).astype(np.int32) + (1 << TABLE_BITS)  # both fit 16 bits
    return np.stack([first, second], 1)


@dataclass
class Net:
    table: np.ndarray  # (2 << TABLE_BITS, DIM)
    filters: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def new(rows: int, seed: int) -> Net:
        """A net of random filters and a table of small random rows but for the last, the blank."""
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (rows, DIM)).astype(np.float32)
        table[-1] = 0
        filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Net(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.tile(np.linspace(0.5, -0.5, FILTERS, dtype=np.float32), len(WIDTHS)), 0.0)

    def responses(self) -> list[np.ndarray]:
        """For each width and place in the filter, the (table rows, FILTERS) responses."""
        return [np.stack([self.table @ f[j] for j in range(len(f))]) for f in self.filters]

    def pooled(self, slots: np.ndarray, first: np.ndarray, responses: list[np.ndarray], where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """(documents, filters) pooled activations, and for training the winning words.

        ``first`` holds each document's first word and the end. A document with
        fewer words than a filter is wide is seen as if followed by blanks.
        """
        n_docs, n = len(first) - 1, len(slots)
        out = np.zeros((n_docs, FILTERS * len(WIDTHS)), np.float32)
        winners = []
        full = np.flatnonzero(np.diff(first))
        if not n:
            return out, [np.zeros((n_docs, FILTERS), np.int64) for _ in WIDTHS]
        last = np.repeat(first[1:], np.diff(first))
        at = np.arange(n)
        for k, w in enumerate(WIDTHS):
            act = responses[k][0][slots[:, 0]] + responses[k][0][slots[:, 1]]
            for j in range(1, w):
                rest = responses[k][j][slots[j:, 0]] + responses[k][j][slots[j:, 1]]
                rest[at[j:] >= last[:-j]] = 0  # past the document's end
                act[: n - j] += rest
            act += self.bias[k]
            best = np.maximum.reduceat(act, first[full], axis=0)
            out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best, 0)
            if where:
                win = np.full((n_docs, FILTERS), -1, np.int64)
                for d, b in zip(full, best, strict=True):
                    s, e = first[d], first[d + 1]
                    win[d] = np.where(b > 0, s + (act[s:e] == b).argmax(0), -1)
                winners.append(win)
        return out, winners

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.offset


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= self.rate * fix * m / (np.sqrt(v) + 1e-7)


def vocabulary(docs: list[np.ndarray]) -> np.ndarray:
    """Table rows of the words that stand in at least LEAST_DOCUMENTS documents, ascending."""
    if not docs:
        return np.zeros(0, np.int64)
    each = [np.unique(d[:, 0].astype(np.int64) << 32 | d[:, 1]) for d in docs]
    word, n = np.unique(np.concatenate(each), return_counts=True)
    word = word[n >= LEAST_DOCUMENTS]
    return np.unique(np.concatenate([word >> 32, word & 0xFFFFFFFF]))


def train(docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Net:
    """Fits a net to documents given as (words, 2) table rows.

    Only the vocabulary's rows are trained, in a small table whose last row is the blank.
    """
    full = Net.new(2 << TABLE_BITS, seed)
    if not len(docs) or y.min() == y.max():
        full.out[:] = 0
        full.offset = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
        return full
    rows = vocabulary(docs)
    place = np.full(2 << TABLE_BITS, len(rows), np.int32)
    place[rows] = np.arange(len(rows))
    docs = [place[d] for d in docs]
    net = Net.new(len(rows) + 1, seed)
    offset = np.array([np.log(y.mean() / (1 - y.mean()))], np.float32)
    adam = Adam([net.table, *net.filters, *net.bias, net.out, offset], 0.01)
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, min(4.0, 0.5 / y.mean()), 1.0)
    order = np.zeros(0, np.int64)
    for step in range(STEPS):
        adam.rate = 0.01 * (1 - step / STEPS) + 0.0005
        if len(order) < min(BATCH, len(docs)):
            order = rng.permutation(len(docs))
        pick, order = order[:BATCH], order[BATCH:]
        slots = np.concatenate([docs[i] for i in pick])
        first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
        pooled, win = net.pooled(slots, first, net.responses(), where=True)
        keep = rng.random(pooled.shape) < 0.8
        seen = pooled * keep / 0.8
        err = ((_sigmoid(seen @ net.out + offset[0]) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
        back = err[:, None] * net.out * keep / 0.8
        d_table = 1e-5 * net.table
        d_filters, d_bias = [], []
        ends = np.repeat(first[1:, None], FILTERS, 1)
        for k, w in enumerate(WIDTHS):
            g = np.where(win[k] >= 0, back[:, k * FILTERS : (k + 1) * FILTERS], 0)
            d_bias.append(g.sum(0))
            df = np.zeros_like(net.filters[k])
            for j in range(w):
                inside = (win[k] >= 0) & (win[k] + j < ends)
                gj = np.where(inside, g, 0)
                at = slots[np.where(inside, win[k] + j, 0)]
                for side in (0, 1):
                    r = at[:, :, side]
                    df[j] += np.einsum("df,dfk->kf", gj, net.table[r])
                    np.add.at(d_table, r.ravel(), (gj[:, :, None] * net.filters[k][j].T[None]).reshape(-1, DIM))
            d_filters.append(df)
        d_table[-1] = 0
        adam.step([d_table, *d_filters, *d_bias, seen.T @ err + 1e-4 * net.out, np.array([err.sum()], np.float32)])
    full.table[:] = 0
    full.table[rows] = net.table[:-1]
    full.filters, full.bias, full.out, full.offset = net.filters, net.bias, net.out, float(offset[0])
    return full


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that best turns ``z`` into chances of label 1 (damped Newton, with Platt's targets)."""
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(z).std()), 1e-3)
    x = np.stack([z / scale, np.ones_like(z)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(200):
        p = _sigmoid(x @ beta)
        grad = x.T @ (weight * (p - target)) + 0.1 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return (float(beta[0] / scale), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def threshold_grid(common: float) -> np.ndarray:
    """The thresholds a language may get, ascending."""
    return np.unique(np.append(np.linspace(0.05, 0.95, 91), common))


def best_threshold(count: np.ndarray, common: float) -> float | None:
    """The threshold with the best F1, the nearest to ``common`` of equals; None with too few rows of either label.

    ``count[k, y]`` is how many rows of label y reach k thresholds of the grid.
    """
    if count.sum(0).min() < LEAST_ROWS:
        return None
    grid = threshold_grid(common)
    above = count[::-1].cumsum(0)[::-1][1:]
    f1 = 2 * above[:, 1] / np.maximum(1, above.sum(1) + count[:, 1].sum())
    best = grid[f1 >= f1.max() - 1e-12]
    return float(best[np.abs(best - common).argmin()])


def language_thresholds(docs: DataFrame, y: DataFrame, model: Model) -> dict[str | None, float]:
    """Thresholds by language from all rows of ``docs`` with a label in ``y`` (doc_id, y); one count for each language, score step and label comes here."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    grid = threshold_grid(model.threshold)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("step", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for batch, texts in text_blocks(batches):
            score = score or held.value.scorer()
            yield record(schema, doc_id=batch.column(0), lang=batch.column(1), step=np.searchsorted(grid, score(texts).astype(np.float64), "right").astype(np.int32))

    steps = docs.mapInArrow(run, "doc_id long, lang string, step int").join(y, "doc_id")
    counts: dict[str | None, np.ndarray] = {}
    for r in steps.groupBy("lang", "step", "y").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["lang"], np.zeros((len(grid) + 1, 2), np.int64))[r["step"], r["y"]] = r["n"]
    best = {code: best_threshold(c, model.threshold) for code, c in counts.items()}
    return {code: t for code, t in best.items() if t is not None}


@dataclass
class Model:
    net: Net
    threshold: float
    by_language: dict[str | None, float]

    def scorer(self):  # noqa: ANN201
        responses = self.net.responses()

        def score(texts: list[bytes]) -> np.ndarray:
            block = Block(texts, ALNUM, lower=True)
            pooled, _ = self.net.pooled(word_slots(block), block.first, responses)
            return _sigmoid(self.net.logit(pooled) * self.net.slope + self.net.shift)

        return score


def within(sizes: list[tuple[int, int]], limit: int) -> list[int]:
    """The ids of (id, size), in their order, that fit into ``limit`` together; what does not fit is passed over."""
    out, left = [], limit
    for doc, n in sizes:
        if n <= left:
            out.append(doc)
            left -= n
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``rows`` labelled documents of either label of those for which ``learn`` (a condition on doc_id) holds.

    A doc_id that several rows share gives one of them, and the sample holds at
    most SAMPLE_WORDS words. The thresholds by language come from all such
    documents but those that the net was trained on.
    """
    wanted = training_labels(labels, "toxic", learn, rows)  # at most 2 * rows
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("y", pa.int32()), ("weight", pa.float64()), ("slots", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            block = Block(texts, ALNUM, lower=True)
            slots = word_slots(block).astype(np.uint16)
            yield record(schema, doc_id=batch.column(0), n=block.n_words, y=batch.column(1), weight=batch.column(2), slots=[slots[a:b].tobytes() for a, b in zip(block.first[:-1], block.first[1:], strict=True)])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text")
    sample = own.join(F.broadcast(wanted), "doc_id").select("doc_id", "y", "weight", "text").mapInArrow(run, "doc_id long, n long, y int, weight double, slots binary")
    sample = cut(sample.groupBy("doc_id").agg(F.min(F.struct("n", "y", "weight", "slots")).alias("s")).select("doc_id", "s.*"), "sample")
    sizes = sample.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most 2 * rows
    chosen = within(sizes, SAMPLE_WORDS)
    got = sorted(sample.where(F.col("n") <= SAMPLE_WORDS).join(F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in chosen], "doc_id long")), "doc_id", "left_semi").collect(), key=lambda r: r["doc_id"])
    words = [np.frombuffer(r["slots"], np.uint16).reshape(-1, 2).astype(np.int32) for r in got]
    y = np.array([r["y"] for r in got], np.int64)
    back = np.arange(len(got)) % HELD_BACK == 0
    net = train([w for w, b in zip(words, back, strict=True) if not b], y[~back])
    z = _logits(net, [w for w, b in zip(words, back, strict=True) if b])
    net.slope, net.shift = platt(z, y[back], np.array([r["weight"] for r in got])[back])
    model = Model(net, threshold, {})
    trained = [(r["doc_id"],) for r, b in zip(got, back, strict=True) if not b]  # fewer than 2 * rows
    del got, words, z  # the driver has done with the sample
    trim()
    rest = labelled(labels, "toxic", learn).join(F.broadcast(docs.sparkSession.createDataFrame(trained, "doc_id long")), "doc_id", "left_anti")
    model.by_language = language_thresholds(own, rest, model)
    return model


def _logits(net: Net, words: list[np.ndarray]) -> np.ndarray:
    if not words:
        return np.zeros(0)
    responses = net.responses()
    parts = []
    for lo in range(0, len(words), BATCH):
        part = words[lo : lo + BATCH]
        first = np.concatenate([[0], np.cumsum([len(w) for w in part])])
        parts.append(net.logit(net.pooled(np.concatenate(part), first, responses)[0]))
    return np.concatenate(parts).astype(np.float64)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, score, rejected) for every row; rejected goes by the row's language."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for batch, texts in text_blocks(batches):
            score = score or held.value.scorer()
            s = score(texts).astype(np.float64)
            limit = np.array([held.value.by_language.get(x, held.value.threshold) for x in batch.column(1).to_pylist()])
            yield record(schema, doc_id=batch.column(0), lang=batch.column(1), score=s, rejected=s >= limit)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text").mapInArrow(run, "doc_id long, lang string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected: one pass over the table and no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = packed(docs, "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for batch, texts in text_blocks(batches):
            score = score or held.value.scorer()
            lang = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
            limit = np.array([held.value.by_language.get(x, held.value.threshold) for x in lang])
            yield batch.select([0]).filter(pa.array(score(texts) < limit))

    return unpacked(rows.mapInArrow(run, StructType([rows.schema["row"]])), docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 2, modulus: int = 4, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, rejected) for every row of ``docs``.

    Learns only from labels whose crc32(doc_id) mod ``modulus`` is not
    ``held_out``. ``predicted`` is score >= threshold; ``rejected`` uses the
    threshold of the document's language.

    A null or empty text has no words and gets the score of an empty document.
    Null doc_ids are scored and not held out. Without usable labels of both
    kinds every score is the share of label 1. Repeated rows get equal scores;
    other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, labels, remainder(F.col("doc_id"), modulus) != held_out, threshold)
    out = classify(docs, model)
    return out.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "rejected",
    )
