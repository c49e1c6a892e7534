"""Learning on graph tables: full-batch descent and Lloyd's k-means as Spark aggregations.

Rows stay where they are. A round sends the small parameters out and gets one
partial sum from each partition back, so the driver holds parameters only.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.errors import ContractError, gathered
from tessera.operators.ids import ranked
from tessera.operators.topology import neighbour_mean


def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, width) of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed(rows: DataFrame, partial: Callable[[dict[str, pa.Array]], np.ndarray]) -> np.ndarray:
    """Sum over all batches of the flat array that ``partial`` makes of a batch's columns."""
    schema = pa.schema([("pos", pa.int32()), ("x", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = partial(dict(zip(b.schema.names, b.columns, strict=True)))
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], schema=schema)

    got = rows.mapInArrow(run, "pos int, x double").groupBy("pos").agg(F.sum("x").alias("x")).collect()  # one row per parameter
    out = np.zeros(max((r["pos"] for r in got), default=-1) + 1)
    for r in got:
        out[r["pos"]] = r["x"]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Softmax:
    weight: np.ndarray
    bias: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(x @ self.weight + self.bias)


def fit_softmax(rows: DataFrame, epochs: int = 40, seed: int = 0, rate: float = 0.2) -> Softmax:
    """Softmax weights for rows (features, label[, weight]) by full-batch descent from seeded normal weights.

    Row weights are scaled to sum to one; without them every row counts the same.
    """
    if "weight" not in rows.columns:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = cut(rows.select("features", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight")), "labelled")
    facts = rows.agg(F.max("label"), F.max(F.size("features")), F.sum("weight"), F.min("label")).first()
    if facts[0] is None:
        raise ContractError(["training requires node labels"])
    if facts[3] < 0:
        raise ContractError(["labels must be >= 0"])
    classes, width, whole = facts[0] + 1, facts[1], max(facts[2], 1e-12)
    model = Softmax(np.random.default_rng(seed).normal(0.0, 0.1, (width, classes)), np.zeros(classes))
    for _ in range(epochs):
        now = model

        def partial(b: dict[str, pa.Array], now: Softmax = now) -> np.ndarray:
            x = _matrix(b["features"])
            g = now.probabilities(x)
            g[np.arange(len(g)), b["label"].to_numpy()] -= 1
            g *= (b["weight"].to_numpy() / whole)[:, None]
            return np.concatenate([(x.T @ g).ravel(), g.sum(0)])

        step = summed(rows, partial)
        model = Softmax(now.weight - rate * step[: width * classes].reshape(width, classes), now.bias - rate * step[width * classes :])
    return model


def predict_softmax(rows: DataFrame, model: Softmax) -> DataFrame:
    """(node, predicted_class, probability) for rows (node, features)."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("node", pa.int64()), ("predicted_class", pa.int32()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = held.value.probabilities(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(p.argmax(1).astype(np.int32)), pa.array(p.max(1))], schema=schema)

    return rows.select(F.col("node").cast("long"), "features").mapInArrow(run, "node long, predicted_class int, probability double")


def fit_sigmoid(rows: DataFrame, epochs: int = 80, seed: int = 0, rate: float = 0.2) -> Softmax:
    """One logistic head for each of several 0/1 targets, for rows (features, targets)."""
    rows = cut(rows.select("features", "targets"), "targets")
    facts = rows.agg(F.count("*"), F.max(F.size("features")), F.max(F.size("targets"))).first()
    n, width, heads = max(facts[0], 1), facts[1] or 0, facts[2] or 0
    model = Softmax(np.random.default_rng(seed).normal(0.0, 0.1, (width, heads)), np.zeros(heads))
    for _ in range(epochs):
        now = model

        def partial(b: dict[str, pa.Array], now: Softmax = now) -> np.ndarray:
            x = _matrix(b["features"])
            g = (sigmoid(x @ now.weight + now.bias) - _matrix(b["targets"])) / n
            return np.concatenate([(x.T @ g).ravel(), g.sum(0)])

        step = summed(rows, partial)
        model = Softmax(now.weight - rate * step[: width * heads].reshape(width, heads), now.bias - rate * step[width * heads :])
    return model


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def standardised(rows: DataFrame) -> DataFrame:
    """(node, features) with mean 0 and standard deviation 1 in each place; constant places are only centred."""
    rows = cut(rows.select("node", "features"), "raw")
    facts = rows.agg(F.max(F.size("features")), F.count("*")).first()
    width, n = facts[0] or 0, max(facts[1], 1)
    mean = summed(rows, lambda b: _matrix(b["features"]).sum(0)) / n if width else np.zeros(0)
    var = summed(rows, lambda b: ((_matrix(b["features"]) - mean) ** 2).sum(0)) / n if width else np.zeros(0)
    scale = np.where(np.sqrt(var) < 1e-8, 1.0, np.sqrt(var))
    m, s = F.array(*map(F.lit, mean.tolist())), F.array(*map(F.lit, scale.tolist()))
    return rows.select("node", F.transform(F.arrays_zip(F.col("features").alias("x"), m.alias("m"), s.alias("s")), lambda z: (z["x"] - z["m"]) / z["s"]).alias("features"))


def kmeans(rows: DataFrame, clusters: int, seed: int = 0, starts: int = 5, rounds: int = 50) -> DataFrame:
    """(node, cluster): Lloyd's algorithm from seeded rows, the best of several starts, on standardised features."""
    data = cut(ranked(standardised(rows), ["node"], "row"), "scaled")
    n = data.count()
    if n < 2:
        raise ContractError([f"{n} rows are too few to cluster"])
    clusters = min(clusters, max(2, n))
    rng = np.random.default_rng(seed)
    draws = [rng.choice(n, size=clusters, replace=False) for _ in range(starts)]
    wanted = sorted({int(i) + 1 for d in draws for i in d})
    picked = {r["row"] - 1: r["features"] for r in data.where(F.col("row").isin(wanted)).collect()}  # one row per cluster and start
    held = [np.array([picked[int(i)] for i in d]) for d in draws]
    inertia, open_ = [np.inf] * starts, list(range(starts))
    for _ in range(rounds):
        # a pass over the rows serves every start that still moves

        def partial(b: dict[str, pa.Array], now: list[np.ndarray] = [held[s] for s in open_]) -> np.ndarray:  # noqa: B006
            x, out = _matrix(b["features"]), []
            for c in now:
                d = _distances(x, c)
                at = d.argmin(1)
                out += [(np.eye(len(c))[at].T @ x).ravel(), np.bincount(at, minlength=len(c)), [d.min(1).sum()]]
            return np.concatenate(out)

        got, moving = np.split(summed(data, partial), len(open_)), []
        for s, part in zip(open_, got, strict=True):
            c = held[s]
            sums, size = part[: c.size].reshape(c.shape), part[c.size : -1]
            new = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
            inertia[s] = part[-1]
            if not np.allclose(new, c):
                held[s] = new
                moving.append(s)
        if not (open_ := moving):
            break
    centres = held[int(np.argmin(inertia))]
    schema = pa.schema([("node", pa.int64()), ("cluster", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(_distances(_matrix(b.column(1)), centres).argmin(1).astype(np.int32))], schema=schema)

    return data.select(F.col("node").cast("long"), "features").mapInArrow(run, "node long, cluster int")


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def predictions(rows: DataFrame, model_id: str, model_version: str, classes: int) -> DataFrame:
    """(target_id, predicted_class, probability, confidence, model_id, model_version) for rows (target_id, predicted_class, probability[, confidence]).

    A class outside the model's, or a number outside 0 to 1, is an error; the
    confidence is the probability where it is not given.
    """
    errors = [f"{what} is empty" for what, v in (("model_id", model_id), ("model_version", model_version)) if not v]
    out = rows if "confidence" in rows.columns else rows.withColumn("confidence", F.col("probability"))
    outside = ~F.coalesce(F.col("predicted_class").between(0, classes - 1) & F.col("probability").between(0, 1) & F.col("confidence").between(0, 1), F.lit(False))
    errors += gathered(out.where(outside).select("target_id", "predicted_class", "probability"), lambda r: f"{r['target_id']} has class {r['predicted_class']} with probability {r['probability']}")
    if errors:
        raise ContractError(errors)
    return out.select("target_id", "predicted_class", "probability", "confidence", F.lit(model_id).alias("model_id"), F.lit(model_version).alias("model_version"))


def covering_rows(rows: DataFrame, share: float) -> DataFrame:
    """(id): rows to train on that hold every label which any row has, then the first others up to ``share`` of all.

    rows (id, order, labels): distinct ``order`` says in which order rows are
    drawn. The first row with a label is taken for it; with more than one row,
    at least one is left out.
    """
    first = rows.select("order", F.explode("labels").alias("label")).groupBy("label").agg(F.min("order").alias("order")).select("order").distinct()
    begun = first.agg(F.min("order").alias("_least"))
    # rows without labels are drawn only before the first row with one; a row without labels that comes first counts as drawn
    blank = rows.where(F.size("labels") == 0).join(F.broadcast(begun)).where("_least is null or order < _least").select("order")
    need = cut(first.unionByName(blank).distinct(), "needed")
    n, k = rows.count(), need.count()
    target = min(n - 1 if n > 1 else 1, max(k, round(share * n), 1))
    rest = ranked(rows.join(need, "order", "left_anti").select("id", "order"), ["order"], "_r").where(F.col("_r") <= target - k)
    return rows.join(need, "order", "left_semi").select("id").unionByName(rest.select("id"))


#: Bits of one half of a number that :func:`permuted` takes.
HALF = 20


def _rounds(seed: int) -> list[tuple[int, int]]:
    """Multiplier and summand of the rounds of :func:`permuted`."""
    draw = random.Random(seed)
    return [(draw.randrange(1 << 41) * 2 + 1, draw.randrange(1 << 42)) for _ in range(6)]


def permuted(number: Column, seed: int) -> Column:
    """A seeded permutation of the numbers below 2**40, by a Feistel network: distinct numbers stay distinct.

    Ordering rows by it draws them in an order that hangs on nothing but their
    numbers and the seed, without a sort of random keys and without the driver.
    """
    mask = F.lit((1 << HALF) - 1).cast("long")
    number = number.cast("long")
    left, right = F.shiftright(number, HALF).bitwiseAND(mask), number.bitwiseAND(mask)
    for factor, summand in _rounds(seed):
        left, right = right, left.bitwiseXOR(F.shiftright(right * F.lit(factor).cast("long") + F.lit(summand).cast("long"), 22).bitwiseAND(mask))
    return F.when((number >= 0) & (number < 1 << 2 * HALF), left * (1 << HALF) + right).otherwise(F.raise_error(F.concat(F.lit("a number to permute lies outside 0 to 2**40 - 1: "), number.cast("string"))))


def permuted_sql(number: str, seed: int) -> str:
    """:func:`permuted` in SQL; the halves of every round are columns of one more subquery."""
    mask = (1 << HALF) - 1
    inner = f"(SELECT *, ({number}) >> {HALF} AS _l, ({number}) & {mask} AS _r"
    out = inner + " FROM {source})"
    for factor, summand in _rounds(seed):
        out = f"(SELECT * REPLACE (_r AS _l, xor(_l, ((_r * {factor} + {summand}) >> 22) & {mask}) AS _r) FROM {out})"
    return f"(SELECT * EXCLUDE (_l, _r), _l * {1 << HALF} + _r AS drawn FROM {out})"


def covering_split(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """(id, trained): :func:`covering_rows` of rows (id, number, labels), drawn in the seed's order of their distinct numbers."""
    rows = cut(rows.select("id", permuted(F.col("number"), seed).alias("order"), "labels"), "drawn")
    chosen = covering_rows(rows, share).withColumn("_t", F.lit(True))
    return rows.select("id").join(chosen, "id", "left").select("id", F.col("_t").isNotNull().alias("trained"))


def class_weights(labels: DataFrame, classes: int) -> DataFrame:
    """(label, weight): all rows over ``classes`` times the rows of a label, for every label that occurs."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("label", (F.col("_all") / (classes * F.col("n"))).alias("weight"))  # one row


def accuracies(rows: DataFrame) -> DataFrame:
    """One row (train, heldout, majority) for rows (label, predicted, trained): shares of right classes, and of the commonest trained class (the smallest of equals) on held-out rows; NaN without rows."""
    common = rows.where("trained").groupBy("label").agg(F.count("*").alias("n")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("_common"))
    nan = F.lit(float("nan"))
    share = lambda c, where: F.coalesce(F.avg(F.when(where, c.cast("double"))), nan)
    right = F.col("label") == F.col("predicted")
    return rows.crossJoin(F.broadcast(common)).agg(share(right, F.col("trained")).alias("train"), share(right, ~F.col("trained")).alias("heldout"), share(F.col("label") == F.coalesce("_common", F.lit(0)), ~F.col("trained")).alias("majority"))  # one row


def micro_f1(rows: DataFrame) -> DataFrame:
    """One row (train, heldout) for rows (targets, guesses, trained) of 0/1 arrays; NaN without rows, 0 without a hit."""
    def of(where: Column) -> Column:
        part = F.when(where, F.arrays_zip("targets", "guesses"))
        count = lambda t, g: F.coalesce(F.sum(F.size(F.filter(part, lambda x: (x["targets"] == t) & (x["guesses"] == g)))), F.lit(0))
        hit, extra, lost = count(1, 1), count(0, 1), count(1, 0)
        return F.when(F.count_if(where & (F.size("targets") > 0)) == 0, float("nan")).when(hit == 0, 0.0).otherwise(2 * hit / (2 * hit + extra + lost))

    return rows.agg(of(F.col("trained")).alias("train"), of(~F.col("trained")).alias("heldout"))


def flagged(rows: DataFrame, names: list[str]) -> DataFrame:
    """(id, name, target, predicted) where a label is wanted or given, for rows (id, targets, guesses) of 0/1 arrays in the order of ``names``."""
    each = rows.select("id", F.posexplode(F.arrays_zip("targets", "guesses")).alias("at", "x"))
    return each.where("x.targets = 1 or x.guesses = 1").select("id", F.array(*map(F.lit, names))[F.col("at")].alias("name"), F.col("x.targets").alias("target"), F.col("x.guesses").alias("predicted"))


@dataclass
class Multitask:
    """A model of node classes and of several yes-or-no labels of edges over scaled places and coverages."""

    node: Softmax
    edge: Softmax
    centre: np.ndarray
    scale: np.ndarray
    threshold: float = 0.5


def _inputs(nodes: DataFrame, edges: DataFrame, centre: np.ndarray, scale: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Neighbour means of scaled node features, and for edges (edge_id, source, target) those of both ends side by side."""
    m, s = F.array(*map(F.lit, centre.tolist())), F.array(*map(F.lit, scale.tolist()))
    scaled = nodes.select("node", F.transform(F.arrays_zip(F.col("features").alias("x"), m.alias("m"), s.alias("s")), lambda z: (z["x"] - z["m"]) / z["s"]).alias("features"))
    hidden = cut(neighbour_mean(scaled, edges), "hidden")
    l, r = (hidden.select(F.col("node").alias(side), F.col("features").alias(name)) for side, name in (("source", "_l"), ("target", "_r")))
    return hidden, edges.join(l, "source").join(r, "target").withColumn("features", F.concat("_l", "_r")).drop("_l", "_r")


def _with_split(rows: DataFrame, key: str, labels: Column, share: float, seed: int) -> DataFrame:
    """``rows`` with a column ``trained``, by :func:`covering_split` over their places in the order of ``key``, where they have none."""
    if "trained" in rows.columns:
        return rows
    numbered = ranked(rows.select(F.col(key).alias("id"), labels.alias("labels")), ["id"], "number")
    split = covering_split(numbered.select("id", F.col("number") - 1, "labels").toDF("id", "number", "labels"), share, seed)
    return rows.join(split.withColumnRenamed("id", key), key)


def fit_multitask(nodes: DataFrame, edges: DataFrame, classes: int, epochs: int = 80, seed: int = 0, rate: float = 0.2, threshold: float = 0.5, share: float = 0.8) -> Multitask:
    """Fits nodes (node, features, label[, trained]) with weights by class, and edges (edge_id, source, target, targets[, trained]).

    Rows without ``trained`` are split by the seed: ``share`` of them, and every
    label at least once, are trained on.
    """
    rows = cut(_with_split(nodes, "node", F.array("label"), share, seed), "nodes")
    held = F.filter(F.transform("targets", lambda t, i: F.when(t > 0, i)), lambda i: i.isNotNull())
    edges = cut(_with_split(edges, "edge_id", held, share, seed), "edges")
    facts = rows.where("trained").select("features")
    width = rows.agg(F.max(F.size("features"))).first()[0] or 0
    stat = facts.agg(*[f(F.col("features")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    centre = np.array([stat[f"m{i}"] or 0.0 for i in range(width)])
    scale = np.array([stat[f"s{i}"] or 0.0 for i in range(width)])
    scale = np.where(scale < 1e-8, 1.0, scale)
    hidden, ends = _inputs(rows.select("node", "features"), edges, centre, scale)
    known = hidden.join(rows.where("trained").select("node", "label"), "node")
    weighted = known.join(F.broadcast(class_weights(known, classes)), "label")  # one row for each class
    node = fit_softmax(weighted.select("features", "label", "weight"), epochs, seed, rate)
    edge = fit_sigmoid(ends.where("trained").select("features", "targets"), epochs, seed + 1, rate)
    return Multitask(node, edge, centre, scale, threshold)


def infer_multitask(model: Multitask, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, predicted_class, probability) and (edge_id, probabilities, guesses) for nodes (node, features) and edges (edge_id, source, target)."""
    hidden, ends = _inputs(nodes.select("node", "features"), edges, model.centre, model.scale)
    held = nodes.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("edge_id", pa.string()), ("probabilities", pa.list_(pa.float64())), ("guesses", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = held.value
                p = sigmoid(_matrix(b.column(1)) @ m.edge.weight + m.edge.bias)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(p.tolist(), schema.field(1).type), pa.array((p >= m.threshold).astype(np.int32).tolist(), schema.field(2).type)], schema=schema)

    scored = ends.select(F.col("edge_id").cast("string"), "features").mapInArrow(run, "edge_id string, probabilities array<double>, guesses array<int>")
    return predict_softmax(hidden, model.node), scored
