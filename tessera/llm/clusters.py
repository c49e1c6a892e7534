"""Exact integer k-means by filtering centroids through kd-trees.

Every task packs its vectors into kd-trees of at most ``TREE`` rows, which are
written once: rows in leaf order, and for each node the number of rows, the
integer sum of their components, the sum of their squares and the bounding box.
A round sends the centroids (k vectors) to the trees. A node keeps the centroids
that may be nearest to some point of its box: one that is strictly farther than
the box's own best centroid from the whole box goes. A node with one centroid
left adds its count and sum without a look at its rows, and so does a box that
is a single point; the rows of other leaves are compared one by one. All numbers
are integers, so sums over tasks, quotients and ties do not hang on any order.

A task gives its sums for each centroid and no more, and the totals of k centroids
come to the driver. Equal vectors, however many, are single-point boxes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.llm.scan import begin_task, record, small_batches

TREE = 4096
LEAF = 32
#: Magnitude below which a squared distance over 64 components fits a long.
LIMIT = 1 << 27
#: Magnitude below which products summed in doubles are exact.
EXACT = 1 << 22

TREES = "ids array<long>, rows binary, first binary, last binary, left binary, low binary, high binary, sums binary, squares binary"
TREES_ARROW = pa.schema([("ids", pa.list_(pa.int64())), *[(name, pa.binary()) for name in ("rows", "first", "last", "left", "low", "high", "sums", "squares")]])
NODE = (("first", np.int32), ("last", np.int32), ("left", np.int32), ("low", np.int32), ("high", np.int32), ("sums", np.int64), ("squares", np.int64))


class Tree:
    """Rows in leaf order and the nodes over them; node 0 is the root, and children stand side by side."""

    def __init__(self, rows: np.ndarray, **nodes: np.ndarray) -> None:
        self.rows = rows
        self.first, self.last, self.left = (nodes[k].astype(np.int64) for k in ("first", "last", "left"))
        self.low, self.high, self.sums = (nodes[k].reshape(-1, rows.shape[1]).astype(np.int64) for k in ("low", "high", "sums"))
        self.squares = nodes["squares"]


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the rows and arrays of the nodes: a box is halved at the median of its widest side."""
    order = np.arange(len(x))
    spans, left, low, high = [(0, len(x))], [], [], []
    for at, (a, b) in enumerate(spans):
        part = x[order[a:b]]
        lo, hi = part.min(0), part.max(0)
        low.append(lo)
        high.append(hi)
        if b - a <= leaf or (lo == hi).all():
            left.append(-1)
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, np.argmax(hi - lo)], middle)]
        left.append(len(spans))
        spans += [(a, a + middle), (a + middle, b)]
        assert left[at] > at
    x = x[order]
    total = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)])
    square = np.concatenate([np.zeros(1, np.int64), np.cumsum((x * x).sum(1))]) if np.abs(x).max() < EXACT else None
    first, last = (np.array([s[k] for s in spans]) for k in (0, 1))
    # squares of far-off rows may sum beyond a long: such nodes are never summed as a whole
    squares = square[last] - square[first] if square is not None else np.full(len(spans), -1)
    return order, {"first": first, "last": last, "left": np.array(left), "low": np.array(low), "high": np.array(high), "sums": total[last] - total[first], "squares": squares}


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer matrix product, by doubles where they are exact."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        return (x * x).sum(1)[:, None] - 2 * _times(x, centroids.T) + (centroids * centroids).sum(1)[None, :]
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def filtered(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole nodes, their clusters, rows of open leaves, their clusters)."""
    k = len(centroids)
    size = (centroids * centroids).sum(1)
    far = np.iinfo(np.int64).max
    node, may = np.zeros(1, np.int64), np.ones((1, k), bool)
    whole, of_whole, rows, of_rows = ([np.zeros(0, np.int64)] for _ in range(4))
    while len(node):
        low, high = tree.low[node], tree.high[node]
        best = np.where(may, distances(low + high, 2 * centroids), far).argmin(1)
        for b in np.unique(best):
            at = np.flatnonzero(best == b)
            step = centroids - centroids[b]
            # of all points of the box, the one that lies farthest towards each centroid
            reach = _times(high[at], np.maximum(step, 0).T) + _times(low[at], np.minimum(step, 0).T)
            may[at] &= size - size[b] - 2 * reach <= 0
        point = (low == high).all(1)
        if point.any():
            best[point] = np.where(may[point], distances(low[point], centroids), far).argmin(1)
        done = point | (may.sum(1) == 1)
        whole.append(node[done])
        of_whole.append(best[done])
        open_ = ~done & (tree.left[node] < 0)
        for n, m in zip(node[open_], may[open_], strict=True):
            at = np.arange(tree.first[n], tree.last[n])
            rows.append(at)
            of_rows.append(np.where(m[None, :], distances(tree.rows[at], centroids), far).argmin(1))
        deeper = ~done & ~open_
        child, may = tree.left[node[deeper]], np.repeat(may[deeper], 2, axis=0)
        node = np.stack([child, child + 1], 1).ravel()
    return tuple(np.concatenate(v) for v in (whole, of_whole, rows, of_rows))


def labelled(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of every row and its squared distance."""
    whole, of_whole, rows, of_rows = filtered(tree, centroids)
    cluster = np.zeros(len(tree.rows), np.int64)
    for n, c in zip(whole, of_whole, strict=True):
        cluster[tree.first[n] : tree.last[n]] = c
    cluster[rows] = of_rows
    return cluster, ((tree.rows - centroids[cluster]) ** 2).sum(1)


def moments(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Rows, component sums and inertia of each cluster."""
    whole, of_whole, rows, of_rows = filtered(tree, centroids)
    k = len(centroids)
    count, total = np.zeros(k, np.int64), np.zeros_like(centroids)
    np.add.at(count, of_whole, tree.last[whole] - tree.first[whole])
    np.add.at(total, of_whole, tree.sums[whole])
    np.add.at(count, of_rows, 1)
    np.add.at(total, of_rows, tree.rows[rows])
    if (tree.squares >= 0).all() and np.abs(centroids).max(initial=0) < EXACT:
        square = np.zeros(k, np.int64)
        np.add.at(square, of_whole, tree.squares[whole])
        np.add.at(square, of_rows, (tree.rows[rows] ** 2).sum(1))
        inertia = square - 2 * (total * centroids).sum(1) + count * (centroids * centroids).sum(1)
        return count, total, inertia.tolist()
    cluster, far = labelled(tree, centroids)
    return count, total, [sum(far[cluster == c].tolist()) for c in range(k)]


def vectors(table: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): vectors of ``dims`` finite components, as floor(``scale`` * component)."""
    whole = F.col("embedding").cast("array<double>")
    sound = (F.size("embedding") == dims) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = table.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("embedding")).where(sound)
    # beyond LIMIT, where no distance fits, a component stays LIMIT, and the trees refuse it
    bound = F.transform("embedding", lambda v: F.floor(F.greatest(F.least(v * F.lit(float(scale)), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return kept.select("vec_id", bound.alias("x"))


def _trees(kept: DataFrame, dims: int) -> DataFrame:
    """The vectors as kd-trees of at most TREE rows, one in a row."""
    def pack(ids: list, x: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(x).astype(np.int64)
        if np.abs(x).max() >= LIMIT:
            raise ValueError(f"scaled components must lie below {LIMIT}, or squared distances do not fit a long")
        order, nodes = build(x)
        values = {"ids": [[ids[i] for i in order]], "rows": [x[order].astype(np.int32).tobytes()]} | {name: [nodes[name].astype(kind).tobytes()] for name, kind in NODE}
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in TREES_ARROW], schema=TREES_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        ids, x = [], []
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            names = batch.column(0).to_pylist()
            at = 0
            while at < len(names):
                take = min(TREE - len(ids), len(names) - at)
                ids += names[at : at + take]
                x.append(flat[at : at + take])
                at += take
                if len(ids) == TREE:
                    yield pack(ids, x)
                    ids, x = [], []
        if ids:
            yield pack(ids, x)

    return small_batches(kept).mapInArrow(run, TREES)


def _read(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[list, Tree]]:
    for batch in batches:
        for r in range(batch.num_rows):
            at = {f: batch.column(i)[r].as_py() for i, f in enumerate(batch.schema.names)}
            rows = np.frombuffer(at["rows"], np.int32).reshape(-1, dims).astype(np.int64)
            yield at["ids"], Tree(rows, **{name: np.frombuffer(at[name], kind) for name, kind in NODE})


def _moved(trees: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """Rows, inertia and component sums by cluster, over all trees."""
    k, dims = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("slot", pa.int32()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
        for _, tree in _read(batches, dims):
            n, s, i = moments(tree, centroids)
            count += n
            total += s
            inertia = [a + b for a, b in zip(inertia, i, strict=True)]
        used = np.flatnonzero(count)
        values = np.column_stack([count, np.array(inertia, np.int64), total])[used]
        yield record(schema, cluster=np.repeat(used, dims + 2), slot=np.tile(np.arange(dims + 2), len(used)), value=values.ravel())

    sums = trees.mapInArrow(run, "cluster int, slot int, value long").groupBy("cluster", "slot").agg(F.sum("value").alias("value"))
    out: dict[int, list[int]] = {}
    for r in sums.orderBy("cluster", "slot").collect():
        out.setdefault(r["cluster"], []).append(r["value"])
    return out


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kmeans(table: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector of ``dims`` finite components.

    Components become floor(``scale`` * x). The vectors with the ``k`` smallest
    sha256 of ``seed:vec_id`` start as centroids; equal hashes (of one vec_id)
    go by their components. Each round moves every centroid that has vectors to
    the floor of their mean; after the last one vectors are assigned once more.
    Ties go to the smaller centroid number.

    Null vectors, and those with another number of components, a null, NaN or
    infinity, give no row. A null vec_id is assigned like any other but starts no
    centroid; repeated rows count as often as they stand. With fewer than ``k``
    vectors there are fewer centroids, and without any there are no rows. Scaled
    components of 2**27 and over are an error, since their distances do not fit.
    Other columns are ignored.
    """
    kept = vectors(table, dims, scale)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.where("vec_id is not null").orderBy(rank, "x").limit(k).collect()
    trees = cut(_trees(kept, dims), "trees")
    centroids = np.array([r["x"] for r in start], np.int64).reshape(-1, dims)
    if not len(centroids):
        return table.sparkSession.createDataFrame([], RESULT)
    for _ in range(rounds):
        for c, (n, _, *total) in _moved(trees, centroids).items():
            centroids[c] = [s // n for s in total]
    inertia = {c: found[1] for c, found in _moved(trees, centroids).items()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _read(batches, dims):
            cluster, far = labelled(tree, centroids)
            own = cluster.tolist()
            arrays = [
                pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(far), pa.array([inertia[c] for c in own], pa.int64()),
                pa.array([sum(inertia.values())] * len(own), pa.int64()), pa.array([digest[c] for c in own], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return trees.mapInArrow(run, RESULT)


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The rows of :func:`kmeans` over ``embeddings``, in DuckDB SQL: every round compares all vectors with all centroids."""
    far = "list_sum(list_transform(list_zip(x, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS z FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min((d, c)) AS best FROM (SELECT r, vec_id, x, c, {far}::BIGINT AS d FROM v, c{i}) GROUP BY r)")
        if i < rounds:
            ctes += [
                f"s{i} AS (SELECT c, j, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(x) AS e, unnest(range({dims})) AS j FROM a{i}) GROUP BY c, j)",
                f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS z FROM s{i} GROUP BY c)",
                f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.z, o.z) AS z FROM c{i} o LEFT JOIN m{i} m USING (c))",
            ]
    last = f"SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = best[2]"
    return "WITH " + ",\n".join(ctes) + "\n" + last
