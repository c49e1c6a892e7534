from tessera.operators.layout_rules import layout_violations

NODES = "dense_id long, node_id string, features array<float>, colors array<int>"


def test_layout_rules(spark):
    nodes = [(0, "a", [1.0, 2.0], [0, 1]), (1, "b", [0.0, 0.0], [1, 1]), (2, "c", [3.0, 1.0], [0, 0])]
    slots, pointers = [(0, 0, 1), (1, 0, 2), (2, 2, 0)], [(0, 0), (1, 2), (2, 2)]

    def found(n, s, p):
        tables = [spark.createDataFrame(n, NODES), spark.createDataFrame(s, "slot long, src long, dst long"), spark.createDataFrame(p, "dense_id long, indptr long")]
        return {(r["rule"], r["at"]) for r in layout_violations(*tables).collect()}

    assert found(nodes, slots, pointers) == set()
    assert found([], [], []) == set()
    bad = [(0, "a", [1.0], [0, 1]), (1, "a", [float("nan"), 0.0], [1, 2]), (3, None, [3.0, 1.0], None)]
    got = found(bad, [(0, 0, 1), (2, 1, 7)], [(0, 0), (1, 1)])
    assert got == {(1, "dense_id"), (2, "a"), (2, None), (3, "slot"), (4, "2"), (5, "2"), (5, "3"), (6, "0"), (6, "1"), (7, "1"), (7, "3")}
