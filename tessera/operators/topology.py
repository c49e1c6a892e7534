"""Topology of edge tables: strands, bubbles, row orders, neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.errors import ContractError
from tessera.operators.ids import ranked


def _strands(edges: DataFrame) -> DataFrame:
    """(source, leaves, target, arrives): an edge's strands; missing or unknown orientation is forward."""
    o = F.when(F.col("orientation").isin("++", "+-", "-+", "--"), F.col("orientation")).otherwise("++") if "orientation" in edges.columns else F.lit("++")
    return edges.select("source", F.left(o, F.lit(1)).alias("leaves"), "target", F.right(o, F.lit(1)).alias("arrives"))


def strand_junctions(edges: DataFrame) -> DataFrame:
    """One row (branch_nodes, join_nodes): nodes with two or more edges out of, or into, one strand."""
    e = _strands(edges)
    out = e.groupBy("source", "leaves").count().where("count > 1").agg(F.countDistinct("source").alias("branch_nodes"))
    into = e.groupBy("target", "arrives").count().where("count > 1").agg(F.countDistinct("target").alias("join_nodes"))
    return out.crossJoin(into)  # one row each


def turning_kmers(nodes: DataFrame, k: int, max_depth: int = 4) -> DataFrame:
    """(source): nodes (node_id, sequence) of a de Bruijn graph whose branches can join within ``max_depth`` steps.

    ``j`` steps behind its first node a branch has lost ``j + 1`` letters of its fork
    in front, and has the letter that tells it from the others ``j`` places before
    its end. So branches never join after equally many steps below k, and after
    different ones, ``i`` and ``j``, only where what is left of the fork's letters
    stands in them ``j - i`` places further on as well. All other forks have no bubble.
    """
    if max_depth >= k:
        return nodes.select(F.col("node_id").alias("source"))
    at = lambda i, n: F.substring("sequence", i + 2, n)
    again = [at(i, k - 1 - j) == at(j, k - 1 - j) for j in range(1, max_depth + 1) for i in range(j)]
    return nodes.where(reduce(Column.__or__, again)).select(F.col("node_id").alias("source"))


def bubble_sources(edges: DataFrame, max_depth: int = 4, among: DataFrame | None = None) -> DataFrame:
    """(source): forks of one strand whose branches join again at most ``max_depth`` steps behind their first nodes.

    Two branches of a fork join where both come to a node at which none of the
    fork begins, or where one comes to the other's first node. Strands of nodes
    are numbers; a branch is known by the strand that it begins with. A round
    moves all branches one step on and keeps, for each fork and place, the least
    and the greatest branch that came there: where they differ the fork's search
    is over, so what moves on is one branch a row, however many a fork has. Forks
    that are not ``among`` (source) the given nodes, if any, are not looked at.
    """
    if max_depth < 1:
        raise ContractError([f"max_depth is {max_depth}, and must be 1 or more"])
    strands = _strands(edges).distinct()
    names = strands.select(F.explode(F.array("source", "target")).alias("name")).distinct().withColumn("n", F.monotonically_increasing_id())
    names = cut(names, "names")
    place = lambda n, strand: F.col(n) * 2 + (F.col(strand) == "-").cast("int")
    ends = [names.select(F.col("name").alias(side), F.col("n").alias(n)) for side, n in (("source", "s"), ("target", "t"))]
    e = cut(strands.join(ends[0], "source").join(ends[1], "target").select(place("s", "leaves").alias("at"), place("t", "arrives").alias("next")), "strands")
    asked = e
    if among is not None:
        numbers = names.join(among.select(F.col("source").alias("name")), "name", "left_semi").select("n")
        asked = e.join(numbers, F.expr("at div 2") == F.col("n"), "left_semi")
    forks = asked.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select("at")
    branches = cut(e.join(forks, "at").select(F.col("at").alias("fork"), F.col("next").alias("start")), "branches")
    front = branches.select("fork", "start", F.col("start").alias("at"))
    none = F.lit(None).cast("long")
    all_ = branches.select("fork", F.expr("start div 2").alias("node"), none.alias("lo"), none.alias("hi"), F.col("start").alias("begins"))
    for step in range(max_depth):
        moved = front.join(e, "at").groupBy("fork", "next").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
        moved = cut(moved, "front") if step + 1 < max_depth else moved
        all_ = all_.unionByName(moved.select("fork", F.expr("next div 2").alias("node"), "lo", "hi", none.alias("begins")))
        front = moved.where("lo = hi").select("fork", F.col("lo").alias("start"), F.col("next").alias("at"))
    met = all_.groupBy("fork", "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("begins").alias("first"), F.max("begins").alias("last"))
    met = met.where("lo < hi or lo <> first or lo <> last").select(F.expr("fork div 2").alias("n")).distinct()
    return met.join(names, "n").select(F.col("name").alias("source"))


def csr_slots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(slot, src, dst, link_id) in row order: by dense source, dense target, link id (nodes: node_id, dense_id)."""
    d = nodes.select("node_id", "dense_id")
    e = edges.join(d.select(F.col("node_id").alias("source"), F.col("dense_id").alias("src")), "source").join(d.select(F.col("node_id").alias("target"), F.col("dense_id").alias("dst")), "target")
    return ranked(e.select("src", "dst", "link_id"), ["src", "dst", "link_id"], "slot").withColumn("slot", F.col("slot") - 1)


def csc_slots(csr: DataFrame) -> DataFrame:
    """(position, dst, slot, src): the same edges by target, stable in row order."""
    return ranked(csr.select("dst", "slot", "src"), ["dst", "slot"], "position").withColumn("position", F.col("position") - 1)


def pointers(slots: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """(dense_id, indptr): how many slots belong to smaller nodes, nodes without edges included."""
    n = slots.groupBy(F.col(side).alias("dense_id")).agg(F.count("*").alias("n"))
    each = nodes.select("dense_id").join(n, "dense_id", "left").select("dense_id", F.coalesce("n", F.lit(0)).alias("n"))
    parts = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(each.repartitionByRange(parts, "dense_id").withColumn("_part", F.spark_partition_id()), "pointers")
    before = dealt.groupBy("_part").agg(F.sum("n").alias("_n")).selectExpr("_part", "sum(_n) over (order by _part) - _n as _before")
    return dealt.join(F.broadcast(before), "_part").selectExpr("dense_id", "_before + sum(n) over (partition by _part order by dense_id) - n as indptr")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of every node with an edge."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def neighbour_mean(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, features): mean of a node's vector and those of its out-neighbours, parallel edges counted each time."""
    links = edges.select("source", "target").unionByName(nodes.select(F.col("node").alias("source"), F.col("node").alias("target")))
    wide = links.join(nodes.select(F.col("node").alias("target"), "features"), "target").select("source", F.posexplode("features").alias("pos", "x"))
    mean = wide.groupBy("source", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = mean.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return rows.select(F.col("source").alias("node"), F.col("p.x").alias("features"))
