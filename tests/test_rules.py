"""Refusals and small pieces: leak lists, short lines, weights, orientations, registries, seeded draws, zipped feeds."""

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import ContractError
from tessera.functions import seq
from tessera.operators import annotate, colour, ml, validate
from tessera.operators.build import Graph, repeat_graph
from tessera.sources import tables, text

EDGE = "edge_id string, source string, target string, orientation string"


def test_leaks(spark):
    rows = spark.createDataFrame([("a", 1, 2, 3, 4)], "node_id string, label int, Expected_Action_id int, genome_abundance int, genome int")
    assert validate.leaking_columns(rows) == ["Expected_Action_id", "genome_abundance"]
    assert validate.leaking_names(["coverage", "f:gold_taxon:0", "truth"]) == ["f:gold_taxon:0"]
    names = spark.createDataFrame([(n,) for n in ("Target", "expected_action", "genome", "answer", "gold", "TRUTH")], "namespace string")
    assert sorted(r[0] for r in validate.leaking_namespaces(names).collect()) == ["TRUTH", "Target", "expected_action", "gold"]
    said = validate.leaks({"features": {"edge": {"target_metric": "int"}}}, rows, rows.select("node_id"), names)
    assert [s.split()[1] for s in said[:3]] == ["target_metric", "Expected_Action_id", "genome_abundance"] and len(said) == 7


@pytest.mark.parametrize(("reader", "lines"), [("gfa", ["S\tx"]), ("gfa", ["S\tx\tACG", "L\tx\t+\tx\t+"]), ("kraken2", ["C\tr1"]), ("kaiju", ["C\tr1\t5", "U\tr2"])])
def test_short_lines_are_named(spark, tmp_path, reader, lines):
    (tmp_path / "f").write_text("\n".join(lines) + "\n")
    with pytest.raises(ContractError, match="too few cells: " + lines[-1].replace("\t", " ").replace("+", r"\+")):
        getattr(text, reader)(spark, str(tmp_path / "f"))


@pytest.mark.parametrize("weight", [0.0, -1.0, float("nan"), float("inf"), None])
def test_weights_are_positive_and_finite(spark, weight):
    members = spark.createDataFrame([("g", "a"), ("g", "b")], "group string, id string")
    values = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, value double")
    weights = spark.createDataFrame([("a", 1.0), ("b", weight)], "id string, weight double")
    with pytest.raises(ContractError, match="member b has no weight above 0"):
        annotate.aggregate(members, values, "weighted_mean", weights=weights)


def test_policies_and_types():
    for policy in annotate.POLICIES:
        for dtype in annotate.DTYPES:
            for vector in (False, True):
                bad = (policy in annotate.NUMERIC and dtype == "category") or (policy in ("union", "majority") and (vector or dtype == "float64"))
                if bad:
                    with pytest.raises(ContractError):
                        annotate.check_policy(policy, dtype, vector)
                else:
                    annotate.check_policy(policy, dtype, vector)
    with pytest.raises(ContractError, match="none of the policies"):
        annotate.check_policy("mode", "int64")


def test_unknown_orientation_is_refused(spark):
    nodes = spark.createDataFrame([("a", "ACGT"), ("b", "CGTA")], "node_id string, sequence string")
    reads = spark.createDataFrame([("r", "s", "ACGTA")], "read_id string, sample_id string, seq string")
    edge = lambda o: spark.createDataFrame([("e", "a", "b", o)], EDGE)
    for o in ("++", "", None):
        assert [tuple(r) for r in colour.colour_edges_by_reads(edge(o), nodes, reads, 4, 1).collect()] == [("e", "s", 1)]
    with pytest.raises(ContractError, match=r"edge e has the orientation \?!"):
        colour.colour_edges_by_reads(edge("?!"), nodes, reads, 4)


def test_colourings_are_dispatched_in_order(spark):
    nodes = spark.createDataFrame([("a", "ACGTT"), ("b", "CGTTA"), ("c", "GGGGG")], "node_id string, sequence string")
    edges = spark.createDataFrame([("e1", "a", "b", "++"), ("e2", "b", "c", "++")], EDGE)
    calls = spark.createDataFrame([("a", 7), ("b", 7), ("b", 8)], "node_id string, taxon int")
    reads = spark.createDataFrame([("r1", "s1", "ACGTTA"), ("r2", "s1", "ACGTTA"), ("r3", "s2", "GGGGG")], "read_id string, sample_id string, seq string")
    none = spark.createDataFrame([], "color_id int, namespace string, value string")
    given = {"calls": calls, "reads": reads, "k": 5}
    assert colour.available({"calls": calls}) == ["calls", "composition", "decaying"]
    n, e, names = colour.colour(Graph(nodes, edges), none, ["calls", "reads"], given)
    of = {r["color_id"]: (r["namespace"], r["value"]) for r in names.collect()}
    shown = lambda rows, key: {r[key]: sorted(of[c] for c in r["color_ids"]) for r in rows.collect()}
    assert shown(n, "node_id") == {"a": [("sample", "s1"), ("taxon", "7")], "b": [("sample", "s1"), ("taxon", "7"), ("taxon", "8")], "c": [("sample", "s2")]}
    assert shown(e, "edge_id") == {"e1": [("sample", "s1"), ("taxon", "7")], "e2": []}
    assert max(i for i, x in of.items() if x[0] == "sample") < min(i for i, x in of.items() if x[0] == "taxon")
    assert colour.namespaces_for(["decaying", "reads", "calls"]) == ["taxon", "sample"]
    with pytest.raises(ContractError, match="colouring reads needs reads and k"):
        colour.colour(Graph(nodes, edges), none, ["reads"], {})
    with pytest.raises(ContractError, match="read sample s2 is not in the dictionary"):
        colour.colour(Graph(nodes, edges), none, ["reads"], given | {"samples": spark.createDataFrame([("s1",)], "sample_id string")})
    with pytest.raises(ContractError, match="paint is no colouring"):
        colour.colour(Graph(nodes, edges), none, ["paint"], {})


def test_containment_by_rarest_seeds(spark):
    rng = random.Random(4)
    repeat = "A" * 40
    large = [(f"l{i}", repeat + "".join(rng.choice("ACGT") for _ in range(60)) + repeat) for i in range(12)]
    small = [(f"s{i}", t[(a := rng.randint(0, 100)) : a + rng.randint(1, 50)]) for i, (_, t) in enumerate(large)] + [("s90", repeat), ("s91", "C" * 30), ("s92", "")]
    rows = lambda x: spark.createDataFrame(x, "id string, s string")
    got = sorted(tuple(r) for r in colour._inside(rows(small), rows(large)).distinct().collect())
    assert got == sorted((a, b) for a, s in small if s for b, t in large if s in t)


def test_seeded_order_is_a_permutation(spark):
    n = 5000
    keys = [r[0] for r in spark.range(n).select(ml.permuted(F.col("id"), 3)).collect()]
    assert len(set(keys)) == n and all(0 <= k < 2**40 for k in keys) and sorted(range(n), key=keys.__getitem__) != list(range(n))
    assert keys != [r[0] for r in spark.range(n).select(ml.permuted(F.col("id"), 4)).collect()]
    low = sum(k < 2**39 for k in keys)
    assert 0.45 * n < low < 0.55 * n
    with pytest.raises(Exception, match="outside 0"):
        spark.range(-1, 0).select(ml.permuted(F.col("id"), 3)).collect()


def test_fit_splits_by_seed_alone(spark):
    rng = random.Random(1)
    nodes = spark.createDataFrame([(i, [float(i % 2), rng.random()], i % 2) for i in range(40)], "node long, features array<double>, label int")
    edges = spark.createDataFrame([(f"e{i}", i, (i + 2) % 40, [i % 2, int(i == 17)]) for i in range(40)], "edge_id string, source long, target long, targets array<int>")
    one, two, three = (ml.fit_multitask(nodes, edges, 2, epochs=4, seed=s) for s in (5, 5, 6))
    assert np.allclose(one.node.weight, two.node.weight) and np.allclose(one.edge.weight, two.edge.weight)
    assert not np.allclose(one.node.weight, three.node.weight)
    split = ml.covering_split(spark.createDataFrame([(i, i, [int(i == 17)]) for i in range(40)], "id long, number long, labels array<int>"), 0.5, 5)
    chosen = {r["id"] for r in split.where("trained").collect()}
    assert 17 in chosen and len(chosen) == 20


def test_zipped_feed_equals_the_folder(spark, tmp_path):
    files = {
        "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\na,\"A, north\",59.5,30\nb,B,59.6,30.1\nz,Z,0,0\n",
        "routes.txt": "route_short_name,route_id,route_type\n7,r1,3\n9,r2,1\n",
        "trips.txt": "trip_id,route_id\nt1,r1\nt2,r2\n",
        "stop_times.txt": "trip_id,stop_id,stop_sequence\nt1,a,1\nt1,b,2\nt2,z,1\n",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    archive = tmp_path / "feed.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, "﻿" + body)
    plain = [sorted(map(tuple, x.collect())) for x in tables.timetable(spark, str(tmp_path), {3: "bus"})]
    assert plain == [sorted(map(tuple, x.collect())) for x in tables.timetable(spark, str(archive), {3: "bus"})]
    assert [r[1] for r in plain[0]] == ["A, north", "B"]
    with zipfile.ZipFile(tmp_path / "short.zip", "w") as z:
        z.writestr("stops.txt", files["stops.txt"])
    with pytest.raises(ContractError, match="has no trips.txt"):
        tables.timetable(spark, str(tmp_path / "short.zip"), {3: "bus"})
    with zipfile.ZipFile(tmp_path / "ragged.zip", "w") as z:
        for name, body in files.items():
            z.writestr(name, body + ("t3\n" if name == "trips.txt" else ""))
    with pytest.raises(Exception, match="a row of trips.txt has 1 cells"):
        tables.timetable(spark, str(tmp_path / "ragged.zip"), {3: "bus"})


def test_genome_folder(spark, tmp_path):
    (tmp_path / "a.fna").write_text(">g1 first\nacgt\nACGN\n>g2\nTTTT\n")
    (tmp_path / "b.FASTA").write_text(">g3\nGG\n")
    (tmp_path / "notes.txt").write_text(">x\nnot a genome\n")
    assert sorted(map(tuple, text.genomes(spark, str(tmp_path)).collect())) == [("g1", "ACGTACGN"), ("g2", "TTTT"), ("g3", "GG")]
    (tmp_path / "c.fa").write_text(">g4\nAXC\n>g5\n")
    with pytest.raises(ContractError, match="genome g4"):
        text.genomes(spark, str(tmp_path))


def test_lists_to_a_graph_without_k(spark):
    nodes = spark.createDataFrame([(1, "ACG", 2, [3, 1, 3])], "id int, sequence string, coverage int, colors array<int>")
    links = spark.createDataFrame([(9, 1, 1, 4, [2])], "id int, source int, target int, coverage int, colors array<int>")
    g = repeat_graph(nodes, links)
    assert [tuple(r) for r in g.nodes.collect()] == [("1", "ACG", 2.0, [1, 3])] and [tuple(r) for r in g.edges.collect()] == [("9", "1", "1", "++", 4.0, [2], None)] and g.k is None
    with pytest.raises(ContractError, match="at least one node"):
        repeat_graph(nodes.limit(0), links)


def test_first_tokens(spark):
    one = spark.createDataFrame([("a.b.c",), ("a",)], "s string")
    assert [r[0] for r in one.select(seq.first_tokens(F.col("s"), ".", 2)).collect()] == ["a.b", "a"]
