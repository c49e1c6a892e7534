"""Tables of all members or edits neither go through the driver nor are written and joined where unitigs hold them."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import cut
from tessera.operators import compact as compacting
from tessera.operators.build import de_bruijn
from tessera.operators.compact import Compacted, compact
from tessera.operators.proposals import apply_proposal
from tessera.operators.runs import whole_groups
from tessera.operators.validate import compacted_violations
from tessera.operators.annotate import Layers, PROVENANCE, attach
from tessera.errors import ContractError

READS = [("r", "ACGTTGCAACGGTACGTTTGACCA"), ("s", "GGTACCATTACGTTG"), ("t", "CCATTACGAAAC")]


@pytest.fixture(scope="module")
def graph(spark):
    return compact(de_bruijn(spark.createDataFrame(READS, "sample_id string, seq string"), 5))


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_groups_are_whole_over_batches():
    keys = ["a", "a", "b", "b", "b", "b", "c", "d", "d"]
    batches = [pa.record_batch({"k": pa.array(keys[i : i + 2])}) for i in range(0, len(keys), 2)]
    found = [t["k"].to_pylist()[b:e] for t, first in whole_groups(iter(batches), 2) for b, e in zip(first, [*first[1:], t.num_rows])]
    assert found == [["a", "a"], ["b"] * 4, ["c"], ["d", "d"]]


def test_edits_of_a_read_graph_write_no_table_of_its_members(spark, graph):
    batch = graph.sizes.where("n >= 3").selectExpr("unitig_id as edit_id", "'split' as kind", "unitig_id", "cast(null as string) as other", "cast(null as string) as link_id", "0 as cut_after", "cast(null as string) as orientation", "cast(null as int) as overlap")
    before = len(cut._MADE)
    one = apply_proposal(graph, batch, "p", "g").graph
    assert not any("/mapping-" in path or "/internal-" in path for path in cut._MADE[before:])
    merges = graph.sizes.where("n = 3").selectExpr("concat('j', unitig_id) as edit_id", "'merge' as kind", "concat('u_p_', unitig_id, '_a') as unitig_id", "concat('u_p_', unitig_id, '_b') as other", "cast(null as string) as link_id", "cast(null as int) as cut_after", "cast(null as string) as orientation", "cast(null as int) as overlap")
    two = apply_proposal(one, merges, "q", "g").graph
    plain = Compacted(cut.cut(graph.mapping), cut.cut(graph.unitigs), graph.links, cut.cut(graph.internal))
    first = apply_proposal(plain, batch, "p", "g").graph
    for got, want in ((one, first), (two, apply_proposal(first, merges, "q", "g").graph)):
        for name in ("mapping", "unitigs", "links", "internal"):
            table = getattr(want, name)
            assert rows(getattr(got, name).select(*table.columns)) == rows(table), name
    assert two.k == graph.k


def test_many_edits_are_joined_by_shuffles(spark, graph, monkeypatch):
    monkeypatch.setattr(cut, "SMALL", 0)
    table = cut.sized(cut.cut(spark.range(10)))
    plan = spark.range(100).join(table, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_walks_without_broadcasts_come_to_the_same(spark, graph, monkeypatch):
    monkeypatch.setattr(compacting, "SMALL", 0)
    again = compact(de_bruijn(spark.createDataFrame(READS, "sample_id string, seq string"), 5))
    assert rows(again.unitigs) == rows(graph.unitigs) and rows(again.links) == rows(graph.links)


def test_repeats_of_nodes_are_found_with_and_without_a_pair(spark, graph):
    meta = {"schema_version": "1.0", "graph_type": "de_bruijn", "k": 5}
    found = lambda c: {(r["rule"], r["at"]) for r in compacted_violations(meta, c).collect()}
    sound = Compacted(graph.mapping, graph.unitigs, graph.links, graph.internal)
    assert found(sound) == set()
    node = graph.mapping.agg(F.min("node_id")).first()[0]
    twice = graph.mapping.unionByName(graph.mapping.where(F.col("node_id") == node))
    assert (15, node) in found(Compacted(twice, graph.unitigs, graph.links, graph.internal))
    alone = graph.mapping.limit(1).withColumn("node_id", F.lit("x"))
    assert {(15, "x"), (16, "x")} <= found(Compacted(graph.mapping.unionByName(alone).unionByName(alone), graph.unitigs, graph.links, graph.internal))
    lost = graph.mapping.where(F.col("node_id") != node)
    copied = graph.unitigs.unionByName(graph.unitigs.where(F.array_contains("members", node)).withColumn("unitig_id", F.lit("copy")))
    assert {(9, node), (16, node)} <= found(Compacted(lost, copied, graph.links, graph.internal))


def test_layers_name_unknown_and_repeated_targets(spark):
    known = spark.createDataFrame([("a",), ("b",)], "target_id string")
    values = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3), ("z", 4)], "target_id string, value int")
    with pytest.raises(ContractError) as e:
        attach(Layers.none(spark), values, known, ("n", "f", "node"), "int64", dict.fromkeys(PROVENANCE, "x"))
    assert "z is no node of the graph" in str(e.value) and "a has 2 values" in str(e.value) and "z has 2 values" in str(e.value)
