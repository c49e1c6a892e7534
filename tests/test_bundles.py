import json

import pytest

from tessera.errors import ContractError
from tessera.operators import colour, ids, ml, score, tensor
from tessera.operators.annotate import PROVENANCE, Layers, attach, feature_block, layer
from tessera.operators.compact import Compacted
from tessera.sources import bundle

META = {"schema_version": "1.0", "graph_id": "g", "graph_type": "repeat", "features": {"node": {"coverage": "float", "color_set": "color_set"}, "edge": {"orientation": "orientation"}}}


def graph(spark, coverage=1.5):
    nodes = spark.createDataFrame([("a", "ACGT", coverage, [0, 1]), ("b", "GGT", 2.0, [])], "node_id string, sequence string, coverage double, color_ids array<int>")
    edges = spark.createDataFrame([("e1", "a", "b", "+-")], "edge_id string, source string, target string, orientation string")
    colors = spark.createDataFrame([(0, "n", "x"), (1, "n", "y")], "color_id int, namespace string, value string")
    return bundle.Bundle(META, nodes, edges, colors)


def test_graph_comes_back(spark, tmp_path):
    path = str(tmp_path / "g")
    bundle.dump_graph(graph(spark), path)
    b = bundle.load_graph(spark, path)
    assert b.metadata == META
    assert sorted((r["node_id"], r["sequence"], r["coverage"], r["color_ids"]) for r in b.nodes.collect()) == [("a", "ACGT", 1.5, [0, 1]), ("b", "GGT", 2.0, [])]
    assert [tuple(r) for r in b.edges.collect()] == [("e1", "a", "b", "+-")]


def test_damaged_folders_are_refused(spark, tmp_path):
    path = str(tmp_path / "g")
    bundle.dump_graph(graph(spark), path)
    meta = next((tmp_path / "g" / "metadata.json").glob("part-*"))
    meta.write_text(json.dumps({**META, "schema_version": "9", "features": {"node": {"coverage": "float"}}}))
    (meta.parent / f".{meta.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ContractError) as caught:
        bundle.load_graph(spark, path)
    assert caught.value.errors == ["schema version 9 is not supported", "node column color_set is not declared", "edge column orientation is not declared"]
    with pytest.raises(ContractError, match="has no nodes.fna"):
        bundle.load_graph(spark, str(tmp_path / "none"))


def test_layers(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "target_id string")
    source = dict.fromkeys(PROVENANCE, "x")
    v = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "target_id string, value double")
    one = attach(Layers.none(spark), v, ids, ("m", "x", "node"), "float64", source)
    assert sorted((r["target_id"], r["numbers"]) for r in layer(one, ("m", "x", "node")).collect()) == [("a", [1.5]), ("b", [2.5])]
    with pytest.raises(ContractError, match="exists already"):
        attach(one, v, ids, ("m", "x", "node"), "float64", source)
    assert attach(one, v, ids, ("m", "x", "node"), "float64", source, replace=True).about.count() == 1
    with pytest.raises(ContractError) as caught:
        attach(one, spark.createDataFrame([("z", 1.0), ("a", None), ("a", 2.0)], "target_id string, value double"), ids, ("m", "y", "node"), "float64", source)
    assert caught.value.errors == ["z is no node of the graph", "a has 2 values", "a has no value of type float64"]
    with pytest.raises(ContractError) as caught:
        attach(one, v, ids, ("m m", "y", "place"), "float64", {"more": 1})
    assert caught.value.errors[:2] == ["namespace 'm m' is no safe name", "target type place is none of node, internal_node, edge, internal_edge"]
    with pytest.raises(ContractError, match="c has no value in m:x:node"):
        feature_block(one, [("m", "x")], spark.createDataFrame([("c",)], "target_id string"), "node")
    with pytest.raises(ContractError, match="no layer"):
        layer(one, ("m", "nothing", "node"))


def test_layout_needs_aligned_features(spark):
    u = spark.createDataFrame([("u1", "ACGT", ["a"], [], []), ("u2", "GGTA", ["b"], [], [])], "unitig_id string, sequence string, members array<string>, internal_edge_ids array<string>, internal_overlaps array<int>")
    m = spark.createDataFrame([("a", "u1", 0, 4), ("b", "u2", 0, 4)], "node_id string, unitig_id string, ordinal int, length int")
    links = spark.createDataFrame([("l", "u1", "u2", "++", 2)], "link_id string, source string, target string, orientation string, overlap int")
    c = Compacted(m, u, links, spark.createDataFrame([], "edge_id string, source string, target string, overlap int"))
    f = spark.createDataFrame([("u1", [1.0]), ("x", [1.0, 2.0])], "unitig_id string, features array<double>")
    with pytest.raises(ContractError) as caught:
        tensor.layout(c, f)
    assert caught.value.errors == ["u2 has no features", "features of x, which is not in the graph", "features differ in width"]
    g = tensor.layout(c)
    assert [(r["dense_id"], r["source_id"]) for r in g.nodes.orderBy("dense_id").collect()] == [(0, "u1"), (1, "u2")]
    assert tensor.feature_names(2, None, ["m:x"]) == ["f0", "f1", "m:x"] and tensor.feature_names(1, ["a", "m:x"], ["m:x"]) == ["a", "m:x"]
    assert [r["origin"] for r in tensor.feature_registry(["a", "m:x"], 1, False, [("m", "m:x")])] == ["explicit", "annotation"]
    with pytest.raises(ContractError, match="nothing stands behind dense id 7"):
        tensor.resolved(g.nodes, u, spark.createDataFrame([(7,)], "dense_id long"))


def test_outside_rows(spark):
    p = spark.createDataFrame([(0, 0), (1, 2), (2, 3), (3, 3)], "dense_id long, indptr long")
    i = spark.createDataFrame([(0, 2, 10), (1, 0, 20), (2, 1, 30)], "place long, dst long, weight int")
    assert [tuple(r) for r in tensor.from_rows(p, i).orderBy("slot").collect()] == [(0, 0, 0, 20), (1, 0, 2, 10), (2, 1, 1, 30)]
    with pytest.raises(ContractError, match="node 0 has the target 2 twice"):
        tensor.from_rows(p, i.withColumn("dst", i.dst * 0 + 2))


def test_long_lineages_and_circles(spark):
    rows = [(i, i - 1, "strain") for i in range(2, 201)] + [(1, 0, "family"), (0, 0, "root"), (900, 901, "strain"), (901, 900, "strain")]
    got = {r["taxon_id"]: r["ancestor"] for r in score.rank_rollup(spark.createDataFrame(rows, "taxon_id long, parent_id long, rank string"), "family").collect()}
    assert all(got[i] == 1 for i in range(1, 201)) and got[0] is None and got[900] is None


@pytest.mark.parametrize(("weights", "total"), [([1000, 1, 1, 1, 900], 20), ([5, 5, 1e-9, 1e-9, 1e-9, 5], 9), ([1, 1, 1], 3), ([9, 1e-9], 4)])
def test_everyone_gets_one(spark, weights, total):
    scale = sum(weights)
    raw = [w * total / scale for w in weights]
    want = [int(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda i: (-(raw[i] - want[i]), i))[: total - sum(want)]:
        want[i] += 1
    while min(want) < 1:
        want[want.index(max(want))] -= 1
        want[want.index(0)] += 1
    got = score.largest_remainder(spark.createDataFrame(list(enumerate(map(float, weights))), "id long, weight double"), total, least=1)
    assert [r["n"] for r in got.orderBy("id").collect()] == want


def test_multitask_learns_classes_and_labels(spark):
    nodes = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2, i < 16) for i in range(20)], "node long, features array<double>, label int, trained boolean")
    edges = spark.createDataFrame([(f"e{i}", i, i, [i % 2], True) for i in range(20)], "edge_id string, source long, target long, targets array<int>, trained boolean")
    model = ml.fit_multitask(nodes, edges, 2, epochs=60, rate=1.0)
    of_node, of_edge = ml.infer_multitask(model, nodes, edges)
    assert {r["node"]: r["predicted_class"] for r in of_node.collect()} == {i: i % 2 for i in range(20)}
    assert {r["edge_id"]: r["guesses"] for r in of_edge.collect()} == {f"e{i}": [i % 2] for i in range(20)}


def test_colouring_names():
    assert colour.namespaces_for(["calls", "reads", "decaying"]) == ["taxon", "sample"]
    with pytest.raises(ContractError, match="smell is no colouring"):
        colour.namespaces_for(["smell"])


def test_compacted_bundles_make_their_tables_once(spark, tmp_path):
    """Rules and files read written tables: what makes unitigs runs once for a dump."""
    from tessera.operators.build import de_bruijn
    from tessera.operators.compact import Compacted, compact

    c = compact(de_bruijn(spark.createDataFrame([("ACGTTGCAACGGT",)], "seq string"), 4))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    u = c.unitigs
    u = u.mapInArrow(counted, u.schema)
    bundle.dump_compacted(bundle.CompactedBundle({"schema_version": "1.0", "graph_type": "de_bruijn", "k": 4}, Compacted(c.mapping, u, c.links, c.internal)), str(tmp_path / "b"))
    assert seen.value == c.unitigs.count()
    back = bundle.load_compacted(spark, str(tmp_path / "b")).graph
    assert sorted(map(tuple, back.internal.collect())) == sorted(map(tuple, c.internal.collect()))


def test_layouts_write_no_members_and_sequences(spark, monkeypatch):
    """What a layout writes grows with its unitigs and not with their members."""
    u = spark.createDataFrame([("u2", "ACGT", ["a", "c"], ["e"], [2]), ("u1", "GGTA", ["b"], [], [])], "unitig_id string, sequence string, members array<string>, internal_edge_ids array<string>, internal_overlaps array<int>")
    links = spark.createDataFrame([("l", "u1", "u2", "++", 2)], "link_id string, source string, target string, orientation string, overlap int")
    written = []
    for module in (tensor, ids):
        monkeypatch.setattr(module, "cut", lambda df, name, cut=module.cut: written.append(set(df.columns)) or cut(df, name))
    g = tensor.layout(Compacted(u, u, links, u))
    assert written and not any(x & {"members", "sequence", "internal_edge_ids", "internal_overlaps"} for x in written)
    assert [(r["dense_id"], r["members"]) for r in g.nodes.orderBy("dense_id").collect()] == [(0, ["b"]), (1, ["a", "c"])]
