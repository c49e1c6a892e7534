"""Graph construction from sequences and visits: k-mer graphs, overlap graphs, successive stops."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.errors import ContractError, require_none
from tessera.functions import seq
from tessera.operators.ids import numbered, ranked
from tessera.operators.readgraph import ReadGraph


@dataclass(frozen=True)
class Graph:
    """nodes (node_id, sequence, ...) and edges (edge_id, source, target, orientation, overlap, ...).

    Edges may be given as a function, which runs when they are first asked for.
    ``exact`` says that overlaps hold by construction, and ``placed`` that the
    edges as given also have ``bucket`` and ``junction``: all edges out of one
    node have the same of both, and so have all edges into one node.
    """

    nodes: DataFrame
    given: DataFrame | Callable[[], DataFrame]
    kind: str = "de_bruijn"
    k: int | None = None
    exact: bool = False
    placed: bool = False

    @cached_property
    def located(self) -> DataFrame:
        return self.given() if callable(self.given) else self.given

    @cached_property
    def edges(self) -> DataFrame:
        return self.located.drop("bucket", "junction") if self.placed else self.located


def kmer_rows(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """(kept columns, pos, kmer): every window of every read; shorter reads give none."""
    return reads.where(F.length("seq") >= k).select(*keep, F.posexplode(seq.kmers(F.col("seq"), k)).alias("pos", "kmer"))


def de_bruijn(reads: DataFrame, k: int) -> ReadGraph:
    """Distinct k-mers as nodes, distinct consecutive pairs as edges.

    Both come from the distinct (k+1)-mers: a window's first and last k letters
    are the pair, so no window function and no self-join is needed, and only a
    read of exactly k letters adds a node by itself. Letters are ASCII.
    """
    if k < 2:
        raise ContractError(["k must be an integer > 1"])
    return ReadGraph(reads, k)


def overlap_pairs(contigs: DataFrame, k: int) -> DataFrame:
    """(source, target): the last k-1 letters of one contig are the first k-1 of another (contigs: id, seq)."""
    a = contigs.select(F.col("id").alias("source"), F.right("seq", F.lit(k - 1)).alias("o"))
    b = contigs.select(F.col("id").alias("target"), F.left("seq", F.lit(k - 1)).alias("o"))
    return a.join(b, "o").where("source <> target").select("source", "target")


def overlap_graph(contigs: DataFrame, k: int) -> Graph:
    """Contigs (id, seq, pos) as nodes numbered by ``pos``, and their overlaps as edges in the order of their ends; a contig shorter than k is an error."""
    require_none(contigs.where(F.length("seq") < k).select("id"), lambda r: f"contig {r['id']} has fewer than {k} letters")
    nodes = cut(ranked(contigs, ["pos"]).select("rank", numbered("n", "rank").alias("node_id"), F.col("seq").alias("sequence")), "contigs")
    pairs = overlap_pairs(nodes.select(F.col("rank").alias("id"), F.col("sequence").alias("seq")), k)
    edges = ranked(pairs.select(F.col("source").alias("a"), F.col("target").alias("b")), ["a", "b"]).select(
        numbered("e", "rank").alias("edge_id"), numbered("n", "a").alias("source"), numbered("n", "b").alias("target"), F.lit("++").alias("orientation"), F.lit(k - 1).alias("overlap")
    )
    return Graph(nodes.select("node_id", "sequence"), edges, "de_bruijn", k, exact=True)


def repeat_graph(nodes: DataFrame, links: DataFrame) -> Graph:
    """A graph without k from nodes (id, sequence, coverage, colors) and links (id, source, target, coverage, colors[, orientation])."""
    if nodes.isEmpty():
        raise ContractError(["a graph needs at least one node"])
    sets = lambda: F.array_sort(F.array_distinct(F.col("colors").cast("array<int>"))).alias("color_ids")
    strand = F.coalesce("orientation", F.lit("++")) if "orientation" in links.columns else F.lit("++")
    n = nodes.select(F.col("id").cast("string").alias("node_id"), "sequence", F.col("coverage").cast("double").alias("coverage"), sets())
    e = links.select(F.col("id").cast("string").alias("edge_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "target")], strand.alias("orientation"), F.col("coverage").cast("double").alias("coverage"), sets(), F.lit(None).cast("int").alias("overlap"))
    return Graph(n, e, "repeat")


def consecutive(visits: DataFrame, group: str, order: list[str], stop: str) -> DataFrame:
    """(group, source, target): successive different stops of each group's visits."""
    w = Window.partitionBy(group).orderBy(*order)
    hop = visits.withColumn("target", F.lead(stop).over(w)).select(group, F.col(stop).alias("source"), "target")
    return hop.where("target is not null and source <> target")
