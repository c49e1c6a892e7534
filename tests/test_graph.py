import random

import pytest

from tessera.errors import ContractError
from tessera.operators import topology
from tessera.operators.build import Graph, de_bruijn, overlap_graph
from tessera.operators.compact import compact, expand
from tessera.operators.components import connected_components
from tessera.operators.edits import merge_unitigs, remove_edges, remove_nodes, split_unitig, upsert
from tessera.operators.ids import ranked

EDGE = "edge_id string, source string, target string, orientation string, overlap int"


def graph(spark, nodes, edges, k=None):
    return Graph(spark.createDataFrame(nodes, "node_id string, sequence string"), spark.createDataFrame(edges, EDGE), "de_bruijn", k)


def model(nodes, edges):
    """Repeated merging of the first candidate, as a check of the closed form."""
    paths = {n: [n] for n, _ in nodes}
    outs = {n: [] for n, _ in nodes}
    for e in sorted(edges):
        outs[e[1]].append(e)
    live, inner = list(edges), set()
    while True:
        out, into = {}, {}
        for e in live:
            out.setdefault(e[1], []).append(e)
            into.setdefault(e[2], []).append(e)
        found = [e for e in live if len(out[e[1]]) == 1 and len(into[e[2]]) == 1 and e[1] != e[2] and e[3] in (None, "++") and e[4] is not None]
        if not found:
            return sorted(paths.values()), inner
        e = min(found, key=lambda x: (x[1], x[2]))
        u, v = e[1], e[2]
        paths[u] += paths.pop(v)
        inner.add(e[0])
        live = [(i, u if s == v else s, t, o, w) for i, s, t, o, w in live if i != e[0]]


def test_compaction_agrees_with_repeated_merging(spark):
    rng = random.Random(5)
    for _ in range(4):
        n = rng.randint(3, 9)
        nodes = [(f"n{i}", "AAAA") for i in range(n)]
        edges = [(f"e{i:02d}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["++", None, "+-"]), rng.choice([2, 2, 2, None])) for i in range(rng.randint(1, n + 2))]
        c = compact(graph(spark, nodes, edges))
        want, inner = model(nodes, edges)
        assert sorted(r["members"] for r in c.unitigs.collect()) == want
        assert {r["edge_id"] for r in c.internal.collect()} == inner


def test_pure_cycle_opens_at_its_smallest_node(spark):
    nodes = [(x, "AAA") for x in "cab"]
    c = compact(graph(spark, nodes, [("e1", "c", "a", "++", 2), ("e2", "a", "b", "++", 2), ("e3", "b", "c", "++", 2)]))
    assert [r["members"] for r in c.unitigs.collect()] == [["a", "b", "c"]]
    assert [(r["link_id"], r["source"], r["target"]) for r in c.links.collect()] == [("e1", "u000001", "u000001")]


def test_chain_sequence_and_round_trip(spark):
    reads = spark.createDataFrame([("ACGTTGCATT",), ("CGTTGCAGG",), ("AC",)], "seq string")
    g = de_bruijn(reads, 4)
    c = compact(g)
    back = expand(c)
    assert sorted(map(tuple, back.nodes.collect())) == sorted(map(tuple, g.nodes.select("node_id", "sequence").collect()))
    assert sorted(map(tuple, back.edges.select("edge_id", "source", "target").collect())) == sorted(map(tuple, g.edges.select("edge_id", "source", "target").collect()))
    assert "ACGTTGCA" in {r["sequence"] for r in c.unitigs.collect()}


def test_overlap_mismatch_is_refused(spark):
    with pytest.raises(ContractError, match="edge e1: the last 2 letters of a do not begin b"):
        compact(graph(spark, [("a", "ACG"), ("b", "TTT")], [("e1", "a", "b", "++", 2)]))


def test_read_of_exactly_k_letters_is_a_node(spark):
    g = de_bruijn(spark.createDataFrame([("ACGT",)], "seq string"), 4)
    assert [tuple(r) for r in g.nodes.collect()] == [("n000001", "ACGT")] and g.edges.count() == 0


def test_contig_overlap(spark):
    rows = spark.createDataFrame([("x", "AACGTT", 1), ("w", "GTTAAA", 2), ("v", "CCCCCC", 3)], "id string, seq string, pos int")
    g = overlap_graph(rows, 4)
    assert sorted(map(tuple, g.nodes.collect())) == [("n000001", "AACGTT"), ("n000002", "GTTAAA"), ("n000003", "CCCCCC")]
    assert [tuple(r) for r in g.edges.collect()] == [("e000001", "n000001", "n000002", "++", 3)]
    with pytest.raises(ContractError, match="fewer than 7 letters"):
        overlap_graph(rows, 7)


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([("a", "b"), ("a", "c")], []),
        ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], ["a"]),
        ([("a", "b"), ("a", "b")], []),
        ([("a", "b"), ("a", "c"), ("b", "c")], ["a"]),
    ],
)
def test_bubbles(spark, edges, want):
    e = spark.createDataFrame(edges, "source string, target string")
    assert [r["source"] for r in topology.bubble_sources(e).collect()] == want


def test_strand_junctions(spark):
    e = spark.createDataFrame([("a", "b", "++"), ("a", "c", "-+"), ("a", "d", "++"), ("x", "b", "++")], "source string, target string, orientation string")
    assert tuple(topology.strand_junctions(e).first()) == (1, 1)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ranks(spark):
    rows = spark.createDataFrame([(x,) for x in "dbca"], "v string")
    assert sorted((r["v"], r["rank"]) for r in ranked(rows, ["v"]).collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_split_and_merge_restore_the_sequence(spark):
    c = compact(graph(spark, [("a", "ACGT"), ("b", "CGTA"), ("c", "GTAC")], [("e1", "a", "b", "++", 3), ("e2", "b", "c", "++", 3)]))
    s = split_unitig(c, "u000001", 0, "p", "x")
    assert {(r["unitig_id"], r["sequence"]) for r in s.unitigs.collect()} == {("u_p_x_a", "ACGT"), ("u_p_x_b", "CGTAC")}
    assert [(r["link_id"], r["source"], r["target"]) for r in s.links.collect()] == [("e1", "u_p_x_a", "u_p_x_b")]
    m = merge_unitigs(s, "u_p_x_a", "u_p_x_b", "q", "y")
    assert [(r["unitig_id"], r["sequence"], r["members"]) for r in m.unitigs.collect()] == [("u_q_y_m", "ACGTAC", ["a", "b", "c"])]
    assert c.unitigs.first()["unitig_id"] == "u000001"
    with pytest.raises(ContractError):
        split_unitig(c, "u000001", 2, "p", "x")
    ids = spark.createDataFrame([("u_p_x_a",)], "unitig_id string")
    with pytest.raises(ContractError, match="still touches"):
        remove_nodes(s, ids)
    gone = remove_nodes(remove_edges(s, spark.createDataFrame([("e1",)], "link_id string")), ids)
    assert [r["unitig_id"] for r in gone.unitigs.collect()] == ["u_p_x_b"]


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, value string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id long, value string")
    assert sorted(map(tuple, upsert(a, b).collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_compaction_leaves_only_tables_that_are_read_later(spark):
    """Of the tables written on the way the nodes and edges of the graph, its merging edges, places and mapping stay."""
    from tessera import cut
    from tessera.operators import build, compact

    before = len(cut._MADE)
    c = compact.compact(build.de_bruijn(spark.createDataFrame([("ACGTTGCAACGGT",), ("GGTACCATT",)], "seq string"), 4))
    left = [path.rsplit("/", 1)[-1].rsplit("-", 1)[0] for path in cut._MADE[before:]]
    assert sorted(left) == ["edges", "mapping", "mergeable", "pairs", "placed", "ranked", "ranked"]
    assert c.mapping.count() == sum(len(r["members"]) for r in c.unitigs.collect()) and c.links.count() + c.internal.count() > 0


def test_only_turning_forks_have_bubbles(spark):
    """Bubbles of a graph of short repeats are found among the forks whose letters allow them, and nowhere else; most forks are left out."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(20)]
    texts += ["".join(rng.choice(["A", "AC", "ACG", "AAT"]) * rng.randint(2, 7) for _ in range(30)) for _ in range(20)]
    for k in (4, 7):
        g = de_bruijn(spark.createDataFrame([(t,) for t in texts], "seq string"), k)
        edges, among = g.edges.localCheckpoint(), topology.turning_kmers(g.nodes, k).localCheckpoint()
        whole = {r[0] for r in topology.bubble_sources(edges).collect()}
        assert {r[0] for r in topology.bubble_sources(edges, among=among).collect()} == whole and whole
    assert 4 * among.count() < g.nodes.count()


def test_links_are_made_without_unitigs_and_are_the_same(spark):
    """Links alone write no unitigs; numbers of unitigs go by the names of their heads, also where those have several lengths."""
    from tessera import cut
    from tessera.operators import compact as module

    rng = random.Random(3)
    reads = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(300)),) for _ in range(3)], "seq string")
    before = len(cut._MADE)
    links = sorted(map(tuple, module.ReadUnitigs(de_bruijn(reads, 5)).links.collect()))
    assert "mapping" not in {path.rsplit("/", 1)[-1].rsplit("-", 1)[0] for path in cut._MADE[before:]}
    c = compact(de_bruijn(reads, 5))
    assert links == sorted(map(tuple, c.links.collect())) and links
    of = {r["node_id"]: r["unitig_id"] for r in c.mapping.collect()}
    edges = {r["edge_id"]: (of[r["source"]], of[r["target"]]) for r in de_bruijn(reads, 5).edges.collect()}
    assert all(edges[r[0]] == (r[1], r[2]) for r in links)
