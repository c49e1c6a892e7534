import pytest

from tessera.errors import ContractError
from tessera.operators.compact import Compacted
from tessera.operators.proposals import application_violations, apply_proposal, proposal_violations

EDITS = "edit_id string, kind string, unitig_id string, other string, link_id string, cut_after int, orientation string, overlap int"


@pytest.fixture(scope="module")
def graph(spark):
    """u1 = n1 n2 n3 leads to u2 = n4 n5; u3 = n6 stands beside and points back at u1."""
    mapping = [("n1", "u1", 0, 4), ("n2", "u1", 1, 4), ("n3", "u1", 2, 4), ("n4", "u2", 0, 4), ("n5", "u2", 1, 4), ("n6", "u3", 0, 4)]
    unitigs = [("u1", "ACGTAC", ["n1", "n2", "n3"], ["e1", "e2"], [3, 3]), ("u2", "TACGG", ["n4", "n5"], ["e4"], [3]), ("u3", "TTTT", ["n6"], [], [])]
    links = [("e3", "u1", "u2", "++", 3), ("e5", "u3", "u1", "+-", None)]
    internal = [("e1", "n1", "n2", 3), ("e2", "n2", "n3", 3), ("e4", "n4", "n5", 3)]
    return Compacted(
        spark.createDataFrame(mapping, "node_id string, unitig_id string, ordinal int, length int"),
        spark.createDataFrame(unitigs, "unitig_id string, sequence string, members array<string>, internal_edge_ids array<string>, internal_overlaps array<int>"),
        spark.createDataFrame(links, "link_id string, source string, target string, orientation string, overlap int"),
        spark.createDataFrame(internal, "edge_id string, source string, target string, overlap int"),
    )


def units(g):
    return {r["unitig_id"]: (r["sequence"], r["members"], r["internal_edge_ids"], r["internal_overlaps"]) for r in g.unitigs.collect()}


def places(g):
    return {r["node_id"]: (r["unitig_id"], r["ordinal"]) for r in g.mapping.collect()}


def ends(g):
    return {(r["link_id"], r["source"], r["target"]) for r in g.links.collect()}


def test_split_then_merge(spark, graph):
    cut = apply_proposal(graph, spark.createDataFrame([("x", "split", "u1", None, None, 0, None, None)], EDITS), "p", "g")
    assert cut.graph_id == "g__p"
    got = units(cut.graph)
    assert got["u_p_x_a"] == ("ACGT", ["n1"], [], []) and got["u_p_x_b"] == ("CGTAC", ["n2", "n3"], ["e2"], [3]) and set(got) == {"u2", "u3", "u_p_x_a", "u_p_x_b"}
    assert places(cut.graph)["n3"] == ("u_p_x_b", 1)
    assert ends(cut.graph) == {("e1", "u_p_x_a", "u_p_x_b"), ("e3", "u_p_x_b", "u2"), ("e5", "u3", "u_p_x_a")}
    assert application_violations(graph, cut).count() == 0
    joined = apply_proposal(cut.graph, spark.createDataFrame([("y", "merge", "u_p_x_b", "u2", None, None, None, None)], EDITS), "q", cut.graph_id)
    assert units(joined.graph)["u_q_y_m"] == ("CGTACGG", ["n2", "n3", "n4", "n5"], ["e2", "e3", "e4"], [3, 3, 3])
    assert places(joined.graph) == {"n1": ("u_p_x_a", 0), "n2": ("u_q_y_m", 0), "n3": ("u_q_y_m", 1), "n4": ("u_q_y_m", 2), "n5": ("u_q_y_m", 3), "n6": ("u3", 0)}
    assert {(r["unitig_id"], r["parent_id"]) for r in joined.parents.collect()} == {("u_q_y_m", "u_p_x_b"), ("u_q_y_m", "u2")}
    assert application_violations(cut.graph, joined).count() == 0


def test_a_batch_removes_first_and_adds(spark, graph):
    batch = [("a", "remove_edge", None, None, "e5", None, None, None), ("b", "remove_node", "u3", None, None, None, None, None), ("c", "add_edge", "u2", "u1", None, None, "+-", None)]
    out = apply_proposal(graph, spark.createDataFrame(batch, EDITS), "p", "g").graph
    assert set(units(out)) == {"u1", "u2"} and ends(out) == {("e3", "u1", "u2"), ("l_p_c", "u2", "u1")} and "n6" not in places(out)


def test_an_empty_batch_changes_nothing(spark, graph):
    out = apply_proposal(graph, spark.createDataFrame([], EDITS), "p", "g").graph
    assert units(out) == units(graph) and ends(out) == ends(graph) and places(out) == places(graph)


def test_all_violations_are_reported(spark, graph):
    batch = [
        ("a", "split", "u1", None, None, 2, None, None), ("a", "merge", "u2", "u3", None, None, None, None), ("b", "flip", "u1", None, None, None, None, None), ("c", "remove_node", "u1", None, None, None, None, None),
        ("d", "remove_edge", None, None, "e9", None, None, None), ("e", "split", None, None, None, 0, None, None), ("f", "add_edge", "u3", "u2", None, None, "++", 3),
    ]
    edits = spark.createDataFrame(batch, EDITS)
    got = {(r["rule"], r["at"]) for r in proposal_violations(graph, edits, "p").collect()}
    assert got == {(1, "a"), (2, "b"), (3, "e"), (4, "d"), (5, "u1"), (5, "u2"), (5, "u3"), (6, "a"), (7, "a"), (8, "f"), (9, "e3"), (9, "e5")}
    with pytest.raises(ContractError):
        apply_proposal(graph, edits, "p", "g")
