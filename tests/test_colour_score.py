import pytest
from pyspark.sql import functions as F

from tessera.errors import ContractError
from tessera.operators import annotate, colour, score, transit, validate


def test_colour_rules_for_absent_elements(spark):
    e = spark.createDataFrame([("a", [0, 1]), ("b", [1])], "id string, color_ids array<int>")
    given = spark.createDataFrame([("a", [1, 2])], "id string, colors array<int>")
    got = {op: {r["id"]: r["color_ids"] for r in colour.apply_colours(e, given, "id", op).collect()} for op in ("replace", "merge", "intersect", "subtract")}
    assert got["replace"] == {"a": [1, 2], "b": []}
    assert got["merge"] == {"a": [0, 1, 2], "b": [1]}
    assert got["intersect"] == {"a": [1], "b": [1]}
    assert got["subtract"] == {"a": [0], "b": []}


def test_colour_by_reads(spark):
    nodes = spark.createDataFrame([("n1", "ATGC"), ("n2", "TGCA")], "node_id string, sequence string")
    edges = spark.createDataFrame([("e1", "n1", "n2", "++")], "edge_id string, source string, target string, orientation string")
    reads = spark.createDataFrame([("r1", "A", "ATGCA"), ("r2", "A", "TGCAT"), ("r3", "B", "ATGC"), ("r4", "C", "TG"), ("r5", "C", "")], "read_id string, sample_id string, seq string")
    n = {(r["node_id"], r["sample_id"]): r["depth"] for r in colour.colour_nodes_by_reads(nodes, reads, 4).collect()}
    assert n == {("n1", "A"): 2, ("n2", "A"): 2, ("n1", "B"): 1, ("n1", "C"): 1, ("n2", "C"): 1}
    assert [tuple(r) for r in colour.colour_edges_by_reads(edges, nodes, reads, 4).collect()] == [("e1", "A", 2)]
    with pytest.raises(ContractError):
        colour.colour_nodes_by_reads(nodes, reads, 4, 0)


def test_colour_joins_broadcast_nothing_that_grows(spark):
    """Counted windows are taken for as small as the reads; a small table must not make their joins broadcast."""
    nodes = spark.createDataFrame([("n1", "ATGCATGCATGCATGCATGC")], "node_id string, sequence string")
    reads = spark.createDataFrame([("r1", "A", "ATGCATGCATGCATGCATGCAA"), ("r2", "A", "GCATGCATGCATGCATGCAT")], "read_id string, sample_id string, seq string")
    for made in (colour.colour_nodes_by_reads(nodes, reads, 20), colour.colour_any_nodes_by_reads(nodes, reads)):
        assert "Broadcast" not in made._jdf.queryExecution().sparkPlan().toString()
        assert [tuple(r) for r in made.collect()] == [("n1", "A", 2)]


def test_decaying_mass(spark):
    own = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 3.0), ("b", 3, 1.0)], "node string, colour long, weight double")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "source string, target string")
    got = {(r["node"], r["colour"]): round(r["mass"], 6) for r in colour.decaying_mass(own, edges, iterations=1).collect()}
    assert got == {("a", 1): 0.5, ("a", 2): 0.375, ("a", 3): 0.125, ("b", 2): 0.75, ("b", 3): 0.25}
    kept = {r["node"]: r["colours"] for r in colour.decaying_colours(colour.decaying_mass(own, edges, iterations=1)).collect()}
    assert kept == {"a": [1], "b": [2]}
    with pytest.raises(ContractError, match="decay is 2.0"):
        colour.decaying_mass(own, edges, decay=2.0)


def test_filter_colours_refuses_unknown_ids(spark):
    e = spark.createDataFrame([("a", [0, 1])], "id string, color_ids array<int>")
    names = spark.createDataFrame([(0, "x", "p"), (1, "y", "q")], "color_id int, namespace string, value string")
    kept, left = colour.filter_colours(e, names, namespaces=["y"])
    assert kept.first()["color_ids"] == [1] and left.count() == 1
    with pytest.raises(ContractError, match="unknown colour id 7"):
        colour.filter_colours(e, names, ids=[7])


def test_aggregation_policies(spark):
    members = spark.createDataFrame([("u", "a"), ("u", "b")], "group string, id string")
    values = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "id string, value double")
    lengths = spark.createDataFrame([("a", 4), ("b", 6)], "id string, weight int")
    assert annotate.aggregate(members, values, "weighted_mean", weights=lengths).first()["value"] == 16.0
    assert annotate.aggregate(members, values, "mean").first()["value"] == 15.0
    assert annotate.aggregate(members, values, "median").first()["value"] == 15.0
    names = spark.createDataFrame([("a", "p"), ("b", "q")], "id string, value string")
    with pytest.raises(ContractError, match="no unique majority"):
        annotate.aggregate(members, names, "majority", "category")
    with pytest.raises(ContractError):
        annotate.aggregate(members, names, "mean", "category")
    with pytest.raises(ContractError, match="no value for member b"):
        annotate.aggregate(members, names.where("id = 'a'"), "union", "category")


def test_scores(spark):
    assert score.n50(spark.createDataFrame([(10,), (20,), (30,)], "length long")).first()[0] == 30
    rows = spark.createDataFrame([("c1", 0), ("c1", 0), ("c2", 1)], "cluster string, truth int")
    assert tuple(score.contig_f1(rows).first()) == (1.0, 1.0, 1.0)
    p = spark.createDataFrame([(1, 0.5), (2, 0.5)], "taxon int, value double")
    t = spark.createDataFrame([(1, 1.0), (3, 1.0)], "taxon int, value double")
    got = score.profile_scores(p, t).first()
    assert got["l1"] == 1.0 and got["presence_f1"] == 0.5
    same = score.profile_scores(p, p).first()
    assert same["l1"] == 0.0 and same["bray_curtis"] == 0.0 and same["presence_f1"] == 1.0 and same["pearson"] is None


def test_taxonomy(spark):
    tax = spark.createDataFrame([(1, 1, "root"), (2, 1, "family"), (3, 2, "genus"), (4, 3, "species"), (5, 6, "species"), (6, 5, "strain")], "taxon_id long, parent_id long, rank string")
    up = {r["taxon_id"]: r["ancestor"] for r in score.rank_rollup(tax, "genus").collect()}
    assert up == {1: None, 2: None, 3: 3, 4: 3, 5: None, 6: None}
    with pytest.raises(ContractError):
        score.rank_rollup(tax, "order")
    dealt = score.largest_remainder(spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, weight long"), 8)
    assert {r["id"]: r["n"] for r in dealt.collect()} == {1: 3, 2: 3, 3: 2}


def test_stop_clusters(spark):
    rows = [(1, "Main  St", 60.0, 30.0), (2, "main st", 60.0003, 30.0), (3, "Main St", 61.0, 30.0), (4, "Other", 60.0, 30.0)]
    got = {r["stop_id"]: r["cluster_id"] for r in transit.cluster_stops(spark.createDataFrame(rows, "stop_id long, name string, lat double, lon double"), 60).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_repeat_junctions_glue(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b")], "source string, target string")
    s = {r["node"]: r["sequence"] for r in transit.repeat_junction_sequences(nodes, edges, 5).collect()}
    assert all(len(x) == 8 for x in s.values())
    assert s["a"][4:] == s["b"][:4] == s["c"][4:]
    with pytest.raises(ContractError):
        transit.repeat_junction_sequences(spark.range(9).select(F.col("id").cast("string").alias("node")), edges, 2)


def test_violations_are_all_reported(spark):
    nodes = spark.createDataFrame([("a", "ACG"), ("a", "AXG"), ("b", "")], "node_id string, sequence string")
    edges = spark.createDataFrame([("e", "a", "z", "+?")], "edge_id string, source string, target string, orientation string")
    with pytest.raises(ContractError) as caught:
        validate.require_valid(validate.graph_violations(nodes, edges))
    assert caught.value.errors == ["duplicate node_id a", "node b has no sequence", "node a has letters outside ACGTN", "edge e has an unknown target z", "edge e has orientation +?"]
    validate.require_valid(validate.graph_violations(nodes.where("sequence = 'ACG'"), edges.where("false")))


def test_decaying_mass_joins_by_shuffles(spark):
    """A round whose joins are too large to broadcast; its plan failed where partitions were put together."""
    own = spark.range(300).selectExpr("id as node", "id % 25 as colour", "cast(1 + id % 2 as double) as weight").where("node % 3 <> 0")
    edges = spark.range(3000).selectExpr("id % 300 as source", "(id * 7 + id div 300) % 300 as target", "1 + id % 3 as weight")
    want = {}
    for r in own.collect():
        want.setdefault(r["node"], {})[r["colour"]] = 1.0
    first, links = dict(want), edges.collect()
    for _ in range(3):
        after = {}
        for node in first:
            votes = [(r["weight"], want[r["target"]]) for r in links if r["source"] == node and r["target"] in want]
            total = sum(w for w, _ in votes)
            colours = {c for _, m in votes for c in m} | set(first[node])
            after[node] = {c: 0.5 * sum(w * m.get(c, 0.0) for w, m in votes) / total + 0.5 * first[node].get(c, 0.0) for c in colours} if votes else first[node]
        want = after
    held = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(c, None)}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {(r["node"], r["colour"]): r["mass"] for r in colour.decaying_mass(own, edges, 0.5, 3).collect()}
    finally:
        for c, value in held.items():
            spark.conf.set(c, value)
    assert got == pytest.approx({(n, c): m for n, cells in want.items() for c, m in cells.items()})
