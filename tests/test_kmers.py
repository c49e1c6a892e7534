import random

import numpy as np
import pytest

from tessera.operators import compact as c
from tessera.operators import kmers
from tessera.operators.build import Graph, de_bruijn
from tessera.operators.colour import colour_nodes_by_reads


def texts(rng, letters="ACGT", n=60):
    base = "".join(rng.choice(letters) for _ in range(400))
    return [base[(a := rng.randrange(400)) : a + rng.randrange(80)] for _ in range(n)] + ["A" * 70, "", "AC"]


@pytest.mark.parametrize(("letters", "k", "heavy"), [("ACGT", 2, kmers.HEAVY), ("ACGT", 6, 20), ("ACGT", 31, kmers.HEAVY), ("ACGT", 35, 20), ("ACGTN", 9, kmers.HEAVY)])
def test_distinct_windows(spark, letters, k, heavy):
    reads = texts(random.Random(k), letters)
    df = spark.createDataFrame([(r,) for r in [*reads, None]], "seq string").repartition(3)
    want = {r[i : i + k] for r in reads for i in range(len(r) - k + 1)}
    rows = kmers.distinct_kmers(df, k, heavy).collect()
    assert sorted(r["kmer"] for r in rows) == sorted(want)
    if k > 2:
        by_junction = {}
        for r in rows:
            by_junction.setdefault(r["kmer"][1:-1], set()).add(r["bucket"])
        assert all(len(b) == 1 for b in by_junction.values())


def test_packed_order_is_the_texts_order():
    rng = random.Random(1)
    reads = [r.encode() for r in texts(rng)]
    w = kmers.Windows(reads, 13)
    keys = w.keys()
    assert keys.dtype == np.uint64 and (kmers.unpacked(keys, 13) == w.texts(w.at)).all()
    order = np.argsort(keys, kind="stable")
    assert (w.texts(w.at)[order] == np.sort(w.texts(w.at))).all()


@pytest.mark.parametrize("letters", ["ACGT", "ACGTN"])
@pytest.mark.parametrize("slice_", [1 << 20, 100])
def test_counts_by_sample(spark, monkeypatch, letters, slice_):
    monkeypatch.setattr(kmers, "SLICE", slice_)
    rng = random.Random(8)
    reads = [(rng.choice(["a", "b", None]), t) for t in texts(rng, letters)]
    df = spark.createDataFrame(reads, "sample_id string, seq string").repartition(2)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    each, once = {}, {}
    for s, t in reads:
        own = [min(t[i : i + 7], rc(t[i : i + 7])) for i in range(len(t) - 6)]
        for w in own:
            each[s, w] = each.get((s, w), 0) + 1
        for w in set(own):
            once[s, w] = once.get((s, w), 0) + 1
    for by_read, want in ((False, each), (True, once)):
        assert {(r["sample_id"], r["kmer"]): r["n"] for r in kmers.sample_counts(df, 7, by_read).collect()} == want


def test_depth_with_short_reads(spark):
    nodes = spark.createDataFrame([("n1", "ACGTT"), ("n2", "CCCCC")], "node_id string, sequence string")
    reads = spark.createDataFrame([("r1", "x", "GGACGTTA"), ("r2", "x", "AACGT"), ("r3", "x", "CGT"), ("r4", "y", "GGG"), ("r5", "y", "ACG")], "read_id string, sample_id string, seq string")
    got = sorted(tuple(r) for r in colour_nodes_by_reads(nodes, reads, 5).collect())
    assert got == [("n1", "x", 3), ("n1", "y", 1), ("n2", "y", 1)]


def paths(result):
    return sorted(tuple(r["members"]) for r in result.unitigs.collect()), sorted(r["edge_id"] for r in result.internal.collect())


@pytest.mark.parametrize(("chunk", "seed"), [(c.CHUNK, 0), (3, 1)])
def test_junction_tasks_agree_with_plain_doubling(spark, monkeypatch, chunk, seed):
    """Paths and cycles, within tasks and across them, come out as from doubling over single edges."""
    monkeypatch.setattr(c, "CHUNK", chunk)
    rng = random.Random(seed)
    ring = "".join(rng.choice("ACGT") for _ in range(40))
    reads = [*texts(rng, n=8), ring + ring[:6], "ACACACACAC", "GATTACAGATTACAGATT"]
    g = de_bruijn(spark.createDataFrame([(r,) for r in reads], "seq string"), 6)
    plain = Graph(g.nodes, g.edges, "de_bruijn", 6, exact=True)
    a, b = c.compact(g), c.compact(plain)
    assert paths(a) == paths(b)
    assert sorted(map(tuple, a.links.collect())) == sorted(map(tuple, b.links.collect()))
    assert sorted(map(tuple, a.mapping.collect())) == sorted(map(tuple, b.mapping.collect()))
    assert {r["sequence"] for r in a.unitigs.collect()} == {r["sequence"] for r in b.unitigs.collect()}


def test_read_graph_with_paths_over_many_tasks(spark, monkeypatch):
    """Paths and cycles that many tasks make, and reads of exactly k letters inside other reads, against plain doubling; no table of all nodes is joined to one of all edges."""
    monkeypatch.setattr(kmers, "SLICE", 12)
    rng = random.Random(3)
    rings = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (40, 7)]
    reads = [*texts(rng, n=6), *[r + r[:7] for r in rings], "GATTACAGATTACAGATT", "TTAGCC", "ATTAGCCA", "TTAGCCTT"]
    g = de_bruijn(spark.createDataFrame([(r,) for r in reads], "seq string").repartition(3), 6)
    want = sorted({r[i : i + 6] for r in reads for i in range(len(r) - 5)})
    assert [r["sequence"] for r in g.nodes.orderBy("node_id").collect()] == want
    pairs = sorted({r[i : i + 7] for r in reads for i in range(len(r) - 6)})
    assert sorted((r["edge_id"], r["source"], r["target"]) for r in g.edges.collect()) == [(f"e{i:06d}", f"n{want.index(p[:6]) + 1:06d}", f"n{want.index(p[1:]) + 1:06d}") for i, p in enumerate(pairs, 1)]
    a, b = c.compact(g), c.compact(Graph(g.nodes, g.edges, "de_bruijn", 6, exact=True))
    assert paths(a) == paths(b)
    assert sorted(map(tuple, a.links.collect())) == sorted(map(tuple, b.links.collect()))
    assert sorted(map(tuple, a.mapping.collect())) == sorted(map(tuple, b.mapping.collect()))
    fields = lambda x: sorted((r["unitig_id"], r["sequence"], r["internal_edge_ids"], r["internal_overlaps"]) for r in x.unitigs.collect())
    assert fields(a) == fields(b)
    assert sorted(map(tuple, c.expand(a).nodes.collect())) == sorted(map(tuple, g.nodes.collect()))
    plan = a.unitigs._jdf.queryExecution().sparkPlan().toString() + a.internal._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_long_path_compacts_and_expands(spark):
    """One unitig of 100 000 members: no row of its expansion holds more than a stretch of its letters."""
    rng = random.Random(11)
    n = 100_000
    text = "".join(rng.choice("ACGT") for _ in range(n + 20))
    reads = spark.createDataFrame([(text[i : i + 1021],) for i in range(0, n, 1000)], "seq string")
    g = de_bruijn(reads, 21)
    made = c.compact(g)
    assert [(r["sequence"], len(r["members"])) for r in made.unitigs.collect()] == [(text, n)]
    back = c.expand(made)
    assert back.nodes.exceptAll(g.nodes).isEmpty() and back.nodes.count() == n
    assert back.edges.select("edge_id", "source", "target").exceptAll(g.edges.select("edge_id", "source", "target")).isEmpty() and back.edges.count() == n - 1


@pytest.mark.parametrize("size", [4, 50])
def test_member_sequences_of_any_length(spark, size):
    """Members shorter and longer than a stretch."""
    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(3, 17))) for _ in range(9)]
    nodes, edges = [(f"n{i}", s) for i, s in enumerate(seqs)], []
    for i in range(1, 9):
        o = rng.randint(0, 3)
        seqs[i] = seqs[i - 1][len(seqs[i - 1]) - o :] + seqs[i][o:]
        nodes[i] = (f"n{i}", seqs[i])
        edges.append((f"e{i}", f"n{i - 1}", f"n{i}", "++", o))
    g = Graph(spark.createDataFrame(nodes, "node_id string, sequence string"), spark.createDataFrame(edges, "edge_id string, source string, target string, orientation string, overlap int"), "repeat")
    made = c.compact(g)
    assert made.unitigs.count() == 1
    assert sorted(map(tuple, c.member_sequences(made, size).collect())) == sorted(nodes)
