"""Document quality by histogram gradient-boosted trees.

Statistics of a document become a few byte-sized bins; trees grow level by
level on per-bin sums of gradients, so a split is found without sorting. The
fitted trees are complete and of one depth, flattened into three arrays, and
scoring walks all trees of all documents at once with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import remainder, training_labels
from tessera.llm.scan import record, small_batches, text_blocks
from tessera.llm.stats import FEATURES, Stats

BINS = 64
DEPTH = 4
TREES = 150
RATE = 0.1
L2 = 1.0
LEAST_WEIGHT = 3.0
#: The most labelled rows of either label that the trees are fitted on.
SAMPLE_ROWS = 20_000


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    limit: np.ndarray  # go right where the value is larger
    leaf: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for rows of features."""
        n, trees = len(x), np.arange(len(self.feature))
        total = np.full(n, self.base)
        for lo in range(0, n, 512):
            part = x[lo : lo + 512]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(DEPTH):
                f = self.feature[trees, node]
                node = 2 * node + 1 + (part[rows, f] > self.limit[trees, node])
            total[lo : lo + 512] += self.leaf[trees, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Fits the trees to the logistic loss."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    w1, w0 = weight[y == 1].sum(), weight[y == 0].sum()
    base = float(np.log((w1 + 0.5) / (w0 + 0.5)))
    if not len(y) or not w1 or not w0:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    place = binned + np.arange(x.shape[1]) * BINS
    z = np.full(len(y), base)
    feature, limit, leaf = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f_tree, l_tree = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(DEPTH):
            n, first = 2**level, 2**level - 1
            where = ((node - first)[:, None] * (x.shape[1] * BINS) + place).ravel()
            shape = (n, x.shape[1], BINS)
            sum_g = np.bincount(where, np.repeat(g, x.shape[1]), np.prod(shape)).reshape(shape).cumsum(2)
            sum_h = np.bincount(where, np.repeat(h, x.shape[1]), np.prod(shape)).reshape(shape).cumsum(2)
            all_g, all_h = sum_g[:, :, -1:], sum_h[:, :, -1:]
            gain = sum_g**2 / (sum_h + L2) + (all_g - sum_g) ** 2 / (all_h - sum_h + L2) - all_g**2 / (all_h + L2)
            gain[(sum_h < LEAST_WEIGHT) | (all_h - sum_h < LEAST_WEIGHT)] = 0
            best = gain.reshape(n, -1).argmax(1)
            for k in range(n):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    f_tree[first + k], l_tree[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), f_tree[node]] > l_tree[node])
        at = node - inner
        value = -RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + L2)
        z += value[at]
        feature.append(f_tree)
        limit.append(l_tree)
        leaf.append(value)
    return Trees(base, np.array(feature), np.array(limit), np.array(leaf))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents of either label for which ``learn`` holds; a doc_id that several rows share gives one."""
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("weight", pa.float64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            x = Stats(texts).features()
            yield record(schema, doc_id=batch.column(0), y=batch.column(1), weight=batch.column(2), x=[v.tobytes() for v in x])

    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = own.join(F.broadcast(training_labels(labels, "quality", learn, rows)), "doc_id").select("doc_id", "y", "weight", "text")
    once = sample.mapInArrow(run, "doc_id long, y int, weight double, x binary").groupBy("doc_id").agg(F.min(F.struct("y", "weight", "x")).alias("s"))
    got = sorted(once.select("doc_id", "s.*").collect(), key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, FEATURES)
    return grow(x, np.array([r["y"] for r in got]), np.array([r["weight"] for r in got], float))


def quality(docs: DataFrame, labels: DataFrame, held_out: int = 0, modulus: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns only from labels whose crc32(doc_id) mod ``modulus`` is not
    ``held_out``; inputs are counts of the text alone.

    A null or empty text is scored on counts of zero. Null doc_ids are scored
    and not held out. Without usable labels of both kinds the score is the share
    of label 1. Repeated rows get equal scores; other columns are ignored; an
    empty table gives no rows.
    """
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, remainder(F.col("doc_id"), modulus) != held_out))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            yield record(schema, doc_id=batch.column(0), score=trees.value.score(Stats(texts).features()))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
