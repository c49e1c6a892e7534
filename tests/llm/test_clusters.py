import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import clusters

COLUMNS = "vec_id long, embedding array<float>"


def brute(rows, k=8, rounds=10, dims=64, seed=3):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    best = [nearest(v) for _, v in kept]
    of = {j: sum(d for d, c in best if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, of[c], sum(of.values()), sha[c]) for (i, _), (d, c) in zip(kept, best, strict=True)), key=str)


def run(df, **options):
    return sorted((tuple(r) for r in clusters.kmeans(df, **options).collect()), key=str)


def test_embeddings_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert run(table.repartition(3), rounds=3) == brute(rows, rounds=3)


def test_small_trees_ties_and_repeats(spark, monkeypatch):
    """Few values in few dimensions: many points lie at equal distances from several centroids."""
    rng = random.Random(1)
    rows = [(i % 90, [float(rng.randint(-2, 2)) / 4 for _ in range(3)]) for i in range(400)] + [(7, [0.25, 0.25, 0.25])] * 50
    monkeypatch.setattr(clusters, "TREE", 64)
    monkeypatch.setattr(clusters, "LEAF", 4)
    assert run(spark.createDataFrame(rows, COLUMNS), dims=3, k=5, rounds=4) == brute(rows, dims=3, k=5, rounds=4)


def test_odd_vectors(spark):
    ok = [0.5, -0.5, 0.001]
    rows = [(1, ok), (1, ok), (None, ok), (2, None), (3, []), (4, [0.1, 0.2]), (5, [0.1, None, 0.3]), (6, [0.1, float("nan"), 0.3]), (7, [float("inf"), 0.0, 0.0]), (8, [9e4, -9e4, 1e-9]), (9, [-0.0, -1e-7, 1.0])]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 as cluster", "2 as x", "3 as ids", "4 as `a.b`")
    assert run(df, dims=3, rounds=2) == brute(rows, dims=3, rounds=2)
    assert clusters.kmeans(df.limit(0), dims=3).count() == 0
    assert clusters.kmeans(df.where("vec_id = 2"), dims=3).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="fit a long"):
        clusters.kmeans(spark.createDataFrame([(1, [1e30, 0.0, 0.0])], COLUMNS), dims=3).collect()


@pytest.mark.parametrize("scale", [50, 1 << 23])
def test_filtering_equals_comparison(scale):
    """Nodes that are assigned whole agree with row-by-row comparison, in doubles and in integers."""
    rng = np.random.default_rng(0)
    middle = rng.integers(-scale, scale, (6, 4))
    x = middle[rng.integers(0, 6, 700)] + rng.integers(-3, 4, (700, 4))
    order, nodes = clusters.build(x, leaf=8)
    tree = clusters.Tree(x[order], **nodes)
    whole, _, rows, _ = clusters.filtered(tree, middle)
    assert len(whole) and len(rows) < len(x)
    cluster, far = clusters.labelled(tree, middle)
    every = ((x[order][:, None, :] - middle[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (far == every.min(1)).all()
    count, total, inertia = clusters.moments(tree, middle)
    assert (count == np.bincount(cluster, minlength=6)).all() and sum(inertia) == int(far.sum())
    assert all((total[c] == x[order][cluster == c].sum(0)).all() for c in range(6))
