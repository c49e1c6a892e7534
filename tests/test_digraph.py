import pytest

from tessera.errors import ContractError
from tessera.operators import tensor
from tessera.operators.identity import edge_index, graph_digest

NODES = "node_id string, pos int, line string, zone string, size string, note string"
EDGES = "source string, target string, pos int, line string, load string"


def build(spark, nodes, edges, **options):
    return tensor.coloured_digraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), **{"k": 4, "colour_columns": ["line", "zone"], "keep_columns": ["size", "note", "load"]} | options)


def test_colours_by_first_sight_over_nodes_then_edges(spark):
    d = build(spark, [("b", 2, "red", "", "1.5", ""), ("a", 1, " blue\t line", "x", "2", None), ("c", 3, None, "y", "", "")], [("b", "c", 2, "green", "3"), ("a", "b", 1, "red", "z")])
    assert [tuple(r) for r in d.dictionary.orderBy("color_id").collect()] == [(0, "line", "blue line"), (1, "line", "red"), (2, "line", "green"), (3, "zone", "x"), (4, "zone", "y")]
    assert {r["node_id"]: (r["color_ids"], r["size"]) for r in d.graph.nodes.collect()} == {"a": ([0, 3], 2.0), "b": ([1], 1.5), "c": ([4], None)}
    assert {r["edge_id"]: (r["source"], r["target"], r["color_ids"], r["line"]) for r in d.graph.edges.collect()} == {"e000001": ("a", "b", [1], "red"), "e000002": ("b", "c", [2], "green")}
    assert d.features == {"node": {"line": "str", "zone": "str", "size": "float"}, "edge": {"orientation": "orientation", "line": "str"}}
    seqs = {r["node_id"]: r["sequence"] for r in d.graph.nodes.collect()}
    assert seqs["a"][3:] == seqs["b"][:3] and seqs["b"][3:] == seqs["c"][:3] and all(len(s) == 6 for s in seqs.values())


@pytest.mark.parametrize(
    ("nodes", "edges", "options", "message"),
    [
        ([], [], {}, "no nodes"),
        ([("a", 1, "r", "", "", ""), ("a", 2, "r", "", "", "")], [], {}, "2 nodes are called 'a'"),
        ([("", 1, "r", "", "", "")], [], {}, "called ''"),
        ([("a", 1, "r", "", "", "")], [("a", "z", 7, "", "")], {}, "the target z of the edge at 7 is no node"),
        ([("a", 1, " ", "", "", "")], [], {}, "no values"),
        ([("a", 1, "r", "", "", "")], [], {"k": 1}, "above 1"),
        ([("a", 1, "r", "", "", "")], [], {"colour_columns": []}, "no column gives colours"),
    ],
)
def test_refusals(spark, nodes, edges, options, message):
    with pytest.raises(ContractError, match=message):
        build(spark, nodes, edges, **options)


def test_column_types(spark):
    rows = spark.createDataFrame([("1", "a", "", "1e5", None), ("2.5", "3", "", " 7 ", "nan")], "a string, b string, c string, d string, e string")
    assert tensor.column_types(rows, list("abcde")) == {"a": "float", "b": "str", "d": "float", "e": "float"}
    assert tensor.column_types(rows, []) == {}


def test_edges_behind_a_layout(spark):
    nodes = spark.createDataFrame([(0, "u1"), (1, "u2")], "dense_id long, source_id string")
    slots = spark.createDataFrame([(0, "e9"), (1, "e7")], "slot long, link_id string")
    mapping = spark.createDataFrame([("n1", "u2", 0), ("n2", "u2", 1), ("n3", "u2", 2), ("n4", "u1", 0)], "node_id string, unitig_id string, ordinal int")
    internal = spark.createDataFrame([("e1", "n1", "n2"), ("e2", "n2", "n3")], "edge_id string, source string, target string")
    got = sorted(tuple(r) for r in edge_index(nodes, slots, mapping, internal).collect())
    assert got == [("node", 1, 1, "e1"), ("node", 1, 2, "e2"), ("slot", 0, 0, "e9"), ("slot", 1, 0, "e7")]
    with pytest.raises(ContractError, match="unitig u1 has no row"):
        edge_index(nodes.where("source_id = 'u2'"), slots, mapping, internal)


def test_identity_follows_every_part(spark):
    rows = spark.createDataFrame([("a", "ACG", [1, 2]), ("b", "CGT", [])], "node_id string, sequence string, color_ids array<int>")
    palette = spark.createDataFrame([(1, "n", "x"), (2, "n", "y")], "color_id int, namespace string, value string")
    meta = {"graph_id": "g", "graph_type": "t", "k": 3}
    one = lambda m=meta, r=rows, p=palette, name="nodes": graph_digest(m, {name: r}, p).first()["digest"]
    same = one()
    assert one(r=rows.orderBy("node_id", ascending=False)) == same
    others = [one(m=meta | {"k": 4}), one(m=meta | {"graph_id": "h"}), one(r=rows.limit(1)), one(p=palette.limit(1)), one(p=None), one(name="edges"), one(r=rows.withColumn("color_ids", rows["color_ids"].cast("array<string>")).replace("ACG", "ACT"))]
    assert same not in others and len(set(others)) == len(others)
