from tessera import cut
from tessera.operators import tensor


def test_edges_of_a_digraph_are_coloured_when_they_are_asked_for(spark):
    nodes = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "node_id string, pos long, kind string")
    edges = spark.createDataFrame([("a", "b", 1, "y"), ("b", "a", 2, "z")], "source string, target string, pos long, kind string")
    before = len(cut._MADE)
    g = tensor.coloured_digraph(nodes, edges, 5, ["kind"])
    count = lambda: sum("/digraph-" in p and not any(f"/digraph-{x}-" in p for x in ("nodes", "edges", "cells", "colours")) for p in cut._MADE[before:])
    assert count() == 1
    assert [r["color_ids"] for r in g.graph.edges.orderBy("edge_id").collect()] == [[1], [2]] and count() == 2
    assert sorted((r["node_id"], r["color_ids"]) for r in g.graph.nodes.collect()) == [("a", [0]), ("b", [1])]
