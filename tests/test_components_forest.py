import random

from tessera.operators import components, transit


def test_a_forest_has_the_same_components_with_at_most_an_edge_a_node(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(f"s{rng.randrange(40)}", f"p{rng.randrange(40)}") for _ in range(1500)] + [("s50", "p50"), ("s51", "p50"), (None, "p1"), ("x", "x")]
    rows = spark.createDataFrame(edges, "src string, dst string").coalesce(2)
    kept = components.forest(rows)
    assert kept.count() <= 2 * 85
    same = sorted(map(tuple, components.connected_components(rows).collect()))
    assert sorted(map(tuple, components.connected_components(kept).collect())) == same and same
    assert components.forest(rows.where("false")).count() == 0


def test_trips_are_put_in_order_once(spark):
    """Routes, stops and hops are read from one written table of steps."""
    from tessera import cut

    stops = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "stop_id long, name string")
    routes = spark.createDataFrame([("r", "bus", "1")], "route_id string, mode string, short_name string")
    visits = spark.createDataFrame([("t", "r", 1, 1), ("t", "r", 2, 2), ("t", "r", 3, 2), ("u", "r", 1, 3)], "trip_id string, route_id string, pos int, stop_id long")
    before = len(cut._MADE)
    nodes, edges, _ = transit.transit_graph(stops, routes, visits, ["bus"], 5, lambda served: served.groupBy("route_id").count().selectExpr("route_id", "cast(count as double) as flow"))
    assert any("/steps-" in path for path in cut._MADE[before:])
    assert sorted((r["node_id"], r["coverage"]) for r in nodes.collect()) == [("s1", 3.0), ("s2", 3.0), ("s3", 3.0)]
    assert [(r["source"], r["target"]) for r in edges.collect()] == [("s1", "s2")]
