import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import ContractError
from tessera.operators import identity, ml, tensor
from tessera.streaming.kmers import kmer_counts, windowed_counts

VECTORS = "node long, features array<double>, label int"


def blobs(spark, n=60, width=3):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, width)) + 6 * (np.arange(n) % 2)[:, None]
    return spark.createDataFrame([(i, [float(v) for v in x[i]], i % 2) for i in range(n)], VECTORS), x


def test_descent_equals_numpy(spark):
    rows, x = blobs(spark)
    y = np.arange(len(x)) % 2
    w, b = np.random.default_rng(4).normal(0, 0.1, (3, 2)), np.zeros(2)
    for _ in range(6):
        g = ml.softmax(x @ w + b)
        g[np.arange(len(x)), y] -= 1
        g /= len(x)
        w, b = w - 0.2 * x.T @ g, b - 0.2 * g.sum(0)
    got = ml.fit_softmax(rows, epochs=6, seed=4)
    assert np.allclose(got.weight, w) and np.allclose(got.bias, b)
    p = {r["node"]: r for r in ml.predict_softmax(rows, got).collect()}
    want = ml.softmax(x @ w + b)
    assert all(p[i]["predicted_class"] == want[i].argmax() and abs(p[i]["probability"] - want[i].max()) < 1e-9 for i in range(len(x)))


def test_sigmoid_heads_learn(spark):
    rows, x = blobs(spark)
    heads = rows.select("features", F.array(F.col("label").cast("double"), 1.0 - F.col("label").cast("double")).alias("targets"))
    m = ml.fit_sigmoid(heads, epochs=40, rate=0.5)
    p = ml.sigmoid(x @ m.weight + m.bias)
    assert ((p[:, 0] > 0.5) == (np.arange(len(x)) % 2 == 1)).mean() > 0.95


def test_kmeans_separates_blobs(spark):
    rows, _ = blobs(spark)
    got = {r["node"]: r["cluster"] for r in ml.kmeans(rows, 2, starts=2, rounds=20).collect()}
    assert len({got[i] for i in range(0, 60, 2)}) == 1 and got[0] != got[1]
    assert got == {r["node"]: r["cluster"] for r in ml.kmeans(rows, 2, starts=2, rounds=20).collect()}
    with pytest.raises(ContractError, match="too few to cluster"):
        ml.kmeans(rows.where("node = 0"), 2)


def test_node_classes(spark):
    nodes = spark.createDataFrame([("a", ["y", "x"]), ("b", []), ("c", []), ("d", [])], "node string, values array<string>")
    links = spark.createDataFrame([("b", "c", ["q"]), ("b", "b", ["p"]), ("c", "b", ["p"])], "source string, target string, values array<string>")
    got = {r["node"]: r["name"] for r in tensor.node_classes(nodes, links).collect()}
    assert got == {"a": "x+y", "b": "p", "c": "p", "d": "Unclassified"}


def test_features_need_every_value(spark):
    e = spark.createDataFrame([("a",), ("b",)], "node_id string")
    layers = spark.createDataFrame([("a", "len", 1.0), ("a", "gc", 0.5), ("b", "len", 2.0), ("b", "gc", 0.25)], "id string, name string, value double")
    got = {r["node_id"]: r["features"] for r in tensor.feature_columns(e, layers, "node_id", ["gc", "len"]).collect()}
    assert got == {"a": [0.5, 1.0], "b": [0.25, 2.0]}
    with pytest.raises(ContractError, match="no annotation value for b"):
        tensor.feature_columns(e, layers.where("id = 'a'"), "node_id", ["gc", "len"]).count()


def test_digest_follows_order_and_content(spark):
    rows = spark.createDataFrame([(i, f"l{i}") for i in range(10)], "i long, line string")
    one = identity.digest(rows, ["i"], "line", fan=3).first()
    assert one["n"] == 10 and one["digest"] == identity.digest(rows.orderBy(F.desc("i")), ["i"], "line", fan=3).first()["digest"]
    assert one["digest"] != identity.digest(rows.withColumn("i", -F.col("i")), ["i"], "line", fan=3).first()["digest"]
    assert identity.digest(rows.where("false"), ["i"], "line").first()["n"] == 0


def test_digest_has_two_levels_as_its_sql(spark):
    """Ten lines in runs of two: more than 2 * 2 lines make no third level."""
    rows = spark.createDataFrame([(i, f"l{i}") for i in range(10)], "i long, line string")
    runs = [hashlib.sha256(f"l{i}\nl{i + 1}".encode()).hexdigest() for i in range(0, 10, 2)]
    assert tuple(identity.digest(rows, ["i"], "line", fan=2).first()) == (hashlib.sha256("\n".join(runs).encode()).hexdigest(), 10)
    assert identity.digest(rows.where("i < 2"), ["i"], "line", fan=2).first()["digest"] == runs[0]


def test_streams(spark, tmp_path):
    reads = spark.createDataFrame([("ACGT",), ("ACG",), ("A",)], "seq string")
    reads.write.parquet(str(tmp_path / "r"))
    q = kmer_counts(spark.readStream.schema("seq string").parquet(str(tmp_path / "r")), 3).writeStream.format("memory").queryName("k").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, kmer_counts(reads, 3).collect()))
    assert sorted(map(tuple, spark.table("k").collect())) == want == [("ACG", 3)]
    e = spark.createDataFrame([("2020-01-01 00:00:10", "a"), ("2020-01-01 00:00:50", "a"), ("2020-01-01 00:01:10", "a")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    assert sorted(r["n"] for r in windowed_counts(e, "t", "k", "1 minute", "1 minute").collect()) == [1, 2]


def test_registered_queries_learn_as_long_as_the_reference(spark, sf, monkeypatch):
    import inspect

    from tessera.plans import catalogue

    def arguments(name):
        real, seen = getattr(ml, name), {}

        def stop(*args, **named):
            bound = inspect.signature(real).bind(*args, **named)
            bound.apply_defaults()
            seen.update(bound.arguments)
            raise InterruptedError

        monkeypatch.setattr(ml, name, stop)
        return seen

    for query, name, want in ((catalogue.kmeans_labels, "kmeans", {"starts": 5, "rounds": 50}), (catalogue.gcn_predict, "fit_softmax", {"epochs": 40})):
        seen = arguments(name)
        with pytest.raises(InterruptedError):
            query(spark, sf)
        assert want.items() <= seen.items()
