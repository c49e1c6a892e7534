import pytest

from tessera.errors import ContractError
from tessera.operators.annotate import PROVENANCE, Layers, aggregate_layer, attach, layer, transfer_layers
from tessera.operators.versions import Version, apply_batch

from .test_proposals import graph  # noqa: F401

EDITS = "edit_id string, kind string, unitig_id string, other string, link_id string, cut_after int, orientation string, overlap int, nth int, target string, target_type string, namespace string, feature string, dtype string, value string"


def edits(spark, *rows):
    names = [c.split()[0] for c in EDITS.split(", ")]
    return spark.createDataFrame([tuple({"nth": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], EDITS)


def source(graph_id="g"):
    return {**dict.fromkeys(PROVENANCE, "x"), "parent_graph_id": graph_id}


@pytest.fixture(scope="module")
def version(spark, graph):  # noqa: F811
    layers = Layers.none(spark)

    def add(rows, kind, key, dtype):
        nonlocal layers
        df = spark.createDataFrame(rows, f"target_id string, value {kind}")
        layers = attach(layers, df, df.select("target_id"), key, dtype, source())

    add([("u3", 10.0)], "double", ("sample", "coverage", "node"), "float64")
    add([("u1", "a"), ("u3", "a")], "string", ("genome", "label", "internal_node"), "category")
    add([("e1", 2**53 + 1), ("e2", 5)], "long", ("sample", "support", "internal_edge"), "int64")
    add([("e5", 7)], "long", ("sample", "weight", "edge"), "int64")
    return Version.first(spark, graph, layers, "g")


def values(v):
    def one(r):
        return r["category"] if r["category"] is not None else (r["whole"] or r["numbers"])[0]

    return {(r["feature"], r["target_type"], r["target_id"]): one(r) for r in v.layers.values.collect()}


def parents(v):
    return {(r["feature"], r["target_type"]): (r["provenance"]["parent_graph_id"], r["provenance"].get("previous_parent_graph_id")) for r in v.layers.about.collect()}


def test_two_batches_move_values_and_keep_history(spark, version):
    first = apply_batch(version, edits(
        spark,
        {"edit_id": "s", "kind": "split", "unitig_id": "u1", "cut_after": 0},
        {"edit_id": "c1", "kind": "change_annotation", "target": "u3", "namespace": "sample", "feature": "coverage", "dtype": "float64", "value": "12.5", "nth": 9},
        {"edit_id": "c0", "kind": "change_annotation", "target": "u3", "namespace": "sample", "feature": "coverage", "dtype": "float64", "value": "11"},
        {"edit_id": "m", "kind": "mark_suspicious", "target": "e3", "target_type": "edge"},
    ), "p")
    got = values(first)
    assert got[("coverage", "node", "u3")] == 12.5 and got[("suspicious", "edge", "e3")] == 1
    assert got[("support", "edge", "e1")] == 2**53 + 1 and got[("support", "internal_edge", "e2")] == 5 and ("support", "internal_edge", "e1") not in got
    assert parents(first)[("support", "edge")] == ("g__p", "g") and parents(first)[("coverage", "node")] == ("g__p", None)
    second = apply_batch(first, edits(spark, {"edit_id": "j", "kind": "merge", "unitig_id": "u_p_s_a", "other": "u_p_s_b"}), "q")
    got = values(second)
    assert got[("support", "internal_edge", "e1")] == 2**53 + 1 and ("support", "edge") not in parents(second)
    assert parents(second)[("label", "internal_node")] == ("g__p__q", "g")
    assert sorted(tuple(r) for r in second.history.collect()) == [(1, "g__p", "g", "p", ["s", "c0", "m", "c1"]), (2, "g__p__q", "g__p", "q", ["j"])]
    assert {r["node_id"] for r in second.graph.mapping.collect()} == {f"n{i}" for i in range(1, 7)}


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ([{"edit_id": "d", "kind": "remove_edge", "link_id": "e5"}], "annotated element would go in edit: d"),
        ([{"edit_id": "d", "kind": "remove_node", "unitig_id": "u3"}], "annotated element would go in edit: d"),
        ([{"edit_id": "c", "kind": "change_annotation", "target": "zz", "namespace": "n", "feature": "f", "dtype": "int64", "value": "1"}], "unknown annotation target in edit: c"),
        ([{"edit_id": "s", "kind": "split", "unitig_id": "u1", "cut_after": 0}, {"edit_id": "m", "kind": "mark_suspicious", "target": "u1"}], "takes away the target of edit: m"),
        ([{"edit_id": "c", "kind": "change_annotation", "target": "u3", "namespace": "sample", "feature": "coverage", "dtype": "int64", "value": "1"}], "another type than edit: c"),
        ([{"edit_id": "c", "kind": "change_annotation", "target": "u3", "namespace": "sample", "feature": "coverage", "dtype": "float64", "value": "Infinity"}], "stated type in edit: c"),
        ([{"edit_id": "c", "kind": "change_annotation", "target": "u3", "feature": "coverage", "dtype": "float64", "value": "1"}], "are wanted in edit: c"),
        ([{"edit_id": "r", "kind": "reassign_label", "target": "u1", "namespace": "genome", "feature": "label", "value": "b"}], "no layer of labels for edit: r"),
        ([{"edit_id": "r", "kind": "reassign_label", "target": "n1", "target_type": "internal_node", "namespace": "genome", "feature": "label", "value": "b"}], "no label to reassign in edit: r"),
        ([{"edit_id": "m", "kind": "mark_suspicious", "target": "n1", "target_type": "internal_node"}], "only nodes and links are marked, not in edit: m"),
        ([{"edit_id": "x", "kind": "paint"}], "unknown kind of edit: x"),
    ],
)
def test_refusals(spark, version, rows, message):
    with pytest.raises(ContractError, match=message):
        apply_batch(version, edits(spark, *rows), "p")


def test_values_that_no_layer_may_hold(spark):
    ids = spark.createDataFrame([("a",)], "target_id string")
    none, key = Layers.none(spark), ("s", "x", "node")
    for value, kind, dtype in ((float("inf"), "double", "float64"), (float("nan"), "double", "float64"), ("1.5", "string", "int64")):
        with pytest.raises(ContractError, match="no value of type"):
            attach(none, spark.createDataFrame([("a", value)], f"target_id string, value {kind}"), ids, key, dtype, source())
    with pytest.raises(ContractError, match="whole numbers"):
        attach(none, spark.createDataFrame([("a", 1.0)], "target_id string, value double"), ids, key, "int64", source())
    row = spark.createDataFrame([("a", 2**53 + 1)], "target_id string, value long")
    meta = {"graph_id": "g", "schema_version": "x", "contract_version": "x"}
    assert layer(attach(none, row, ids, key, "int64", source(), graph=meta), key).first()["whole"] == [2**53 + 1]
    for wrong in ({"graph_id": "h"}, {"schema_version": "2"}, {"contract_version": "2"}):
        with pytest.raises(ContractError, match="the parent's"):
            attach(none, row, ids, key, "int64", source(), graph=meta | wrong)
    with pytest.raises(ContractError, match="empty or no text"):
        attach(none, row, ids, key, "int64", source() | {"method": ""})


def test_layers_of_groups_record_their_policy(spark):
    rows = spark.createDataFrame([("n1", 4), ("n2", 2**53 + 1), ("n3", 6)], "target_id string, value long")
    layers = attach(Layers.none(spark), rows, rows.select("target_id"), ("s", "x", "internal_node"), "int64", source())
    members = spark.createDataFrame([("u1", "n1"), ("u1", "n2"), ("u2", "n3")], "group string, id string")
    for policy in ("max", "mean", "keep_per_member"):
        layers = aggregate_layer(layers, ("s", "x", "internal_node"), members, "node", policy, source())
    about = {(r["feature"], r["target_type"]): (r["dtype"], r["aggregation"]) for r in layers.about.collect()}
    assert about == {("x", "internal_node"): ("int64", None), ("x.max", "node"): ("int64", "max"), ("x.mean", "node"): ("float64", "mean"), ("x.keep_per_member", "internal_node"): ("int64", "keep_per_member")}
    assert {r["target_id"]: r["whole"] for r in layer(layers, ("s", "x.max", "node")).collect()} == {"u1": [2**53 + 1], "u2": [6]}
    with pytest.raises(ContractError, match="needs a scalar int64"):
        aggregate_layer(attach(layers, spark.createDataFrame([("n1", 1.0)], "target_id string, value double"), rows.select("target_id"), ("s", "y", "internal_node"), "float64", source()), ("s", "y", "internal_node"), members, "node", "union", source())


def test_transfer_splits_edges_by_where_they_are(spark, graph):  # noqa: F811
    nodes = spark.createDataFrame([(f"n{i}", str(i)) for i in range(1, 7)], "node_id string, coverage string")
    edges = spark.createDataFrame([(f"e{i}", str(2**53 + i), "k") for i in range(1, 6)], "edge_id string, support string, kind string")
    out = transfer_layers(Layers.none(spark), nodes, edges, graph.mapping, graph.links, graph.internal, {"node": {"coverage": "float64"}, "edge": {"support": "int64", "kind": "category"}}, "cfa", source())
    got = {}
    for r in out.values.where("feature in ('support', 'coverage')").collect():
        got.setdefault((r["feature"], r["target_type"]), {})[r["target_id"]] = (r["whole"] or r["numbers"])[0]
    assert got[("support", "internal_edge")] == {e: 2**53 + int(e[1]) for e in ("e1", "e2", "e4")} and set(got[("support", "edge")]) == {"e3", "e5"}
    assert got[("coverage", "internal_node")]["n6"] == 6.0
    with pytest.raises(ContractError, match="blank cell"):
        transfer_layers(Layers.none(spark), nodes, edges.replace("k", " "), graph.mapping, graph.links, graph.internal, {"edge": {"kind": "category"}}, "cfa", source())
