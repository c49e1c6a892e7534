from pyspark.sql import functions as F

from tessera.functions import seq
from tessera.operators import colour
from tessera.operators.build import de_bruijn

READS = [("a", "ACGTTGCAACGGTACGTT"), ("b", "GGTACCATTACGTTG"), ("b", "ACGTT"), ("c", "ACG")]


def test_motifs_of_a_read_graph_are_those_of_its_edges_without_a_join(spark):
    g = de_bruijn(spark.createDataFrame(READS, "sample_id string, seq string"), 4)
    l, r = (g.nodes.select(F.col("node_id").alias(side), F.col("sequence").alias(name)) for side, name in (("source", "l"), ("target", "r")))
    want = g.edges.join(l, "source").join(r, "target").select("edge_id", seq.junction(F.col("l"), F.col("r"), 4).alias("motif"))
    assert sorted(map(tuple, g.motifs.collect())) == sorted(map(tuple, want.collect()))
    joins = [x for x in g.motifs._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "BroadcastHashJoin" not in x]
    assert not joins


def test_edges_are_coloured_by_their_motifs_as_by_their_ends(spark):
    reads = spark.createDataFrame(READS, "sample_id string, seq string")
    g = de_bruijn(reads, 4)
    want = colour.colour_edges_by_reads(g.edges, g.nodes, reads, 4)
    got = colour.colour_motifs_by_reads(g.motifs, reads, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
