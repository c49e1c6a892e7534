"""Compaction of non-branching paths into unitigs, and its inverse.

An edge u -> v merges where it is the only one out of u and the only one into v,
u is not v, its orientation is forward or missing and its overlap is known.
Merging edges form disjoint paths and cycles. Where edges come with the minimiser
of their junction, a task sees all edges of its junctions: it decides which of
them merge and joins them to paths as far as it sees. What is left are the ends
at which paths of different tasks meet; a path's distance to its head is found by
pointer doubling over those pieces, so n of them take log2(n) rounds. What never
finds a head lies on a cycle, which is opened at its smallest node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.cut import SMALL, cut, cut_round, settled, shuffled, sized
from tessera.errors import require_none
from tessera.functions import seq
from tessera.operators.build import Graph
from tessera.operators.ids import numbered, ranked
from tessera.operators.readgraph import ReadGraph, numbered_nodes, outward
from tessera.operators.runs import whole_groups


#: Edges that a task joins to paths at a time.
CHUNK = 1 << 18
#: Up to this number names of nodes are ordered as their numbers are.
SIX_DIGITS = 999_999
#: Members, or letters, of a unitig that are handled together.
STRETCH = 4096


@dataclass(frozen=True)
class Compacted:
    """mapping (node_id, unitig_id, ordinal, length), unitigs, links and the edges inside unitigs.

    ``k`` is set where every node has k letters and overlaps the next by k - 1;
    mapping and internal then hold what :func:`placed` and :func:`inner_edges` read
    from the unitigs.
    """

    mapping: DataFrame
    unitigs: DataFrame
    links: DataFrame
    internal: DataFrame
    k: int | None = None

    @property
    def sizes(self) -> DataFrame:
        """(unitig_id, n, letters): how many members and letters."""
        return self.unitigs.select("unitig_id", F.size("members").alias("n"), F.length("sequence").alias("letters"))


def placed(unitigs: DataFrame, k: int) -> DataFrame:
    """(node_id, unitig_id, ordinal, length) of the members of unitigs whose nodes have k letters."""
    return unitigs.select(F.posexplode("members").alias("ordinal", "node_id"), "unitig_id").select("node_id", "unitig_id", "ordinal", F.lit(k).alias("length"))


def inner_edges(unitigs: DataFrame) -> DataFrame:
    """(edge_id, source, target, overlap) of the edges inside unitigs."""
    inner = F.expr("transform(sequence(1, size(members) - 1), i -> struct(internal_edge_ids[i - 1] as edge_id, members[i - 1] as source, members[i] as target, internal_overlaps[i - 1] as overlap))")
    return unitigs.where("size(members) > 1").select(F.explode(inner).alias("e")).select("e.*")


def mergeable(edges: DataFrame) -> DataFrame:
    """The edges that compaction absorbs (cycles still whole)."""
    out = edges.groupBy("source").agg(F.count("*").alias("_out"))
    into = edges.groupBy("target").agg(F.count("*").alias("_in"))
    forward = edges.where("source <> target and coalesce(orientation, '++') in ('++', '') and overlap is not null")
    return forward.join(out.where("_out = 1"), "source", "left_semi").join(into.where("_in = 1"), "target", "left_semi")


def _walk(state: DataFrame) -> tuple[DataFrame, int]:
    """Doubles (node, jump, dist, done) until no unfinished node reaches a head any more."""
    left = state.where("not done").count()
    while left:
        hop = state.select(F.col("node").alias("jump"), F.col("jump").alias("far"), F.col("dist").alias("more"), F.col("done").alias("end"))
        # files of numbers look small to Spark, however many rows they have
        open_ = F.broadcast(state.where("not done")) if left <= SMALL else shuffled(state.where("not done"))
        open_ = open_.join(hop, "jump").select("node", F.col("far").alias("jump"), (F.col("dist") + F.col("more")).alias("dist"), F.col("end").alias("done"))
        state = cut_round(state.where("done").unionByName(open_), "walk")
        now = state.where("not done").count()
        if now == left:
            break
        left = now
    return state, left


def _cycle_minimum(ring: DataFrame, n: int) -> DataFrame:
    """(node, least): the smallest ``least`` of each cycle, for ring (node, prev, least)."""
    state = ring.select("node", F.col("prev").alias("jump"), "least")
    span = 1
    while span < n:
        hop = state.select(F.col("node").alias("jump"), F.col("jump").alias("far"), F.col("least").alias("other"))
        state = cut(state.join(hop, "jump").select("node", F.col("far").alias("jump"), F.least("least", "other").alias("least")), "ring")
        span *= 2
    return state.select("node", "least")


def overlap_mismatches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, source, target, overlap) of forward edges whose ends do not overlap as stated."""
    forward = edges.where("coalesce(orientation, '++') in ('++', '') and overlap is not null")
    l = nodes.select(F.col("node_id").alias("source"), F.col("sequence").alias("_l"))
    r = nodes.select(F.col("node_id").alias("target"), F.col("sequence").alias("_r"))
    wrong = forward.join(l, "source").join(r, "target").where(~seq.overlaps(F.col("_l"), F.col("_r"), F.col("overlap")))
    return wrong.select("edge_id", "source", "target", "overlap")


MERGED = "edge_id string, source string, target string, overlap int, head string, dist int, last boolean, root string"


def _chains(located: DataFrame) -> DataFrame:
    """MERGED rows: the merging edges, joined to paths as far as the edges of a task's junctions go.

    ``head`` is the first node of such a path, ``dist`` the number of edges from it
    to ``target``, and ``last`` whether the path ends there. Of a cycle that lies
    in the task altogether, ``root`` is the smallest node; its edge into the root
    is left out.
    """
    def solve(edges: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(edges).combine_chunks()
        n = table.num_rows
        ends = pa.concat_arrays([table["source"].combine_chunks(), table["target"].combine_chunks()]).dictionary_encode()
        names, code = ends.dictionary, ends.indices.to_numpy()
        source, target = code[:n], code[n:]
        size = len(names)
        plain = np.array([o in (None, "", "++") for o in table["orientation"].to_pylist()], bool) & table["overlap"].is_valid().to_numpy()
        merges = np.flatnonzero(plain & (source != target) & (np.bincount(source, minlength=size)[source] == 1) & (np.bincount(target, minlength=size)[target] == 1))
        before = np.full(size, -1)
        before[target[merges]] = source[merges]
        head, dist = np.where(before >= 0, before, np.arange(size)), (before >= 0).astype(np.int64)
        for _ in range(size.bit_length()):
            dist, head = dist + dist[head], head[head]
        ring = before[head] >= 0
        root = np.full(size, -1)
        for x in np.flatnonzero(ring).tolist():
            if root[x] >= 0:
                continue
            loop = [x]
            while before[loop[-1]] != x:
                loop.append(int(before[loop[-1]]))
            loop.reverse()
            at = loop.index(min(loop, key=lambda i: names[i].as_py()))
            for d, node in enumerate(loop[at:] + loop[:at]):
                head[node], dist[node], root[node] = loop[at], d, loop[at]
        merges = merges[dist[target[merges]] > 0]
        goes_on = np.zeros(size, bool)
        goes_on[source[merges]] = True
        t = target[merges]
        rows = table.take(merges)
        return pa.RecordBatch.from_arrays(
            [*[rows[c].combine_chunks() for c in ("edge_id", "source", "target", "overlap")], names.take(pa.array(head[t])), pa.array(dist[t], pa.int32()), pa.array(~goes_on[t]), names.take(pa.array(np.maximum(root[t], 0), mask=root[t] < 0))],
            names=[f.split()[0] for f in MERGED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            if total >= CHUNK:
                # what follows may belong to the junction that is held last
                junction = batch.column(5).to_numpy()
                same = int(np.argmax(np.append(junction != held[-1].column(5)[-1].as_py(), True)))
                held.append(batch.slice(0, same))
                batch = batch.slice(same)
                if batch.num_rows:
                    yield solve(held)
                    held, total = [], 0
            if batch.num_rows:
                held.append(batch)
                total += batch.num_rows
        if held:
            yield solve(held)

    edges = located.select("edge_id", "source", "target", F.col("orientation"), F.col("overlap").cast("int").alias("overlap"), "junction", "bucket")
    parts = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartitionByRange(parts, "bucket", "junction").sortWithinPartitions("bucket", "junction").mapInArrow(run, MERGED)


def _places(merge: DataFrame) -> tuple[DataFrame, bool]:
    """The first of what :func:`_joined` gives, and whether a cycle lay over several pieces."""
    piece = merge.where("last and root is null").select("head", F.col("target").alias("tail"), F.col("dist").alias("size"))
    prior = piece.select(F.col("tail").alias("node"), F.col("head").alias("prev"), "size")
    start = piece.select(F.col("head").alias("node")).join(prior, "node", "left")
    start = start.select("node", F.coalesce("prev", "node").alias("jump"), F.coalesce("size", F.lit(0)).cast("long").alias("dist"), F.col("prev").isNull().alias("done"))
    state, rings = _walk(cut(start, "start"))
    inside = merge.where("root is not null").select(F.col("target").alias("node_id"), F.col("root").alias("head"), F.col("dist").cast("long").alias("ordinal"), "overlap", "edge_id")
    base = state.where("done").select(F.col("node").alias("head"), F.col("jump").alias("first"), F.col("dist").alias("base"), F.lit(None).cast("long").alias("around"))
    if rings:
        # A cycle over several pieces starts at its smallest node, wherever in a piece that lies.
        ring = cut(state.where("not done").select("node").join(prior, "node"), "rings")
        own = merge.where("root is null").join(ring.select(F.col("node").alias("head")), "head", "left_semi")
        least = own.groupBy("head").agg(F.min("target").alias("least"))
        roots = cut(_cycle_minimum(ring.join(least.withColumnRenamed("head", "node"), "node"), rings), "least")
        begin = own.join(roots.select(F.col("least").alias("target")).distinct(), "target").select(F.col("head").alias("node"), F.col("dist").alias("at"))
        opened = ring.join(begin, "node", "left")
        again = opened.select("node", F.when(F.col("at").isNotNull(), F.col("node")).otherwise(F.col("prev")).alias("jump"), F.when(F.col("at").isNotNull(), 0).otherwise(F.col("size")).cast("long").alias("dist"), F.col("at").isNotNull().alias("done"))
        state, _ = _walk(cut(again, "start"))
        sizes = ring.join(roots, "node").groupBy("least").agg(F.sum("size").alias("around"))
        turned = state.select("node", F.col("jump"), "dist").join(begin.select(F.col("node").alias("jump"), "at"), "jump").join(roots, "node").join(sizes, "least")
        base = base.unionByName(turned.select(F.col("node").alias("head"), F.col("least").alias("first"), (F.col("dist") - F.col("at") + F.col("around")).alias("base"), F.col("around").cast("long").alias("around")))
    base = cut(base, "pieces")
    far = F.col("base") + F.col("dist")
    placed = merge.where("root is null").join(base, "head").select(F.col("target").alias("node_id"), F.col("first").alias("head"), F.when(F.col("around").isNull(), far).otherwise(far % F.col("around")).alias("ordinal"), "overlap", "edge_id")
    return placed.unionByName(inside).where("ordinal > 0"), bool(rings)


def _joined(merge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, head, ordinal, overlap, edge_id) of every node behind its path's first one, and the edges that paths take up (MERGED).

    A path that goes on in another task has its last node as that one's head; only
    such pieces, one row each, go through pointer doubling.
    """
    cyclic = []

    def placed() -> DataFrame:
        rows, rings = _places(merge)
        cyclic.append(rings)
        return rows

    rows = settled(placed, "placed")
    return rows, merge.join(rows.select("edge_id"), "edge_id", "left_semi") if cyclic[0] else merge


def running(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over a group's rows up to each, for ``order`` 0, 1, 2, ...

    Sums go over stretches of ``STRETCH`` rows, and then over those, so a long
    group is not one task's.
    """
    rows = rows.withColumn("_v", value).withColumn("_b", F.expr(f"{order} div {STRETCH}"))
    whole = rows.groupBy(group, "_b").agg(F.sum("_v").alias("_s"))
    whole = whole.select(group, "_b", (F.sum("_s").over(Window.partitionBy(group).orderBy("_b")) - F.col("_s")).alias("_s"))
    inside = F.sum("_v").over(Window.partitionBy(group, "_b").orderBy(order))
    return rows.join(whole, [group, "_b"]).withColumn(name, inside + F.col("_s")).drop("_v", "_b", "_s")


def _read_places(graph: ReadGraph, ends: DataFrame) -> DataFrame:
    """(id, first, base, around): for each path of a read graph the path that its unitig begins in, and the steps before its first node.

    ``around`` is the length of a cycle over several paths and null elsewhere; its
    ``first`` is the path that holds its smallest node.
    """
    piece = ends.where("out_of is not null").select(F.col("out_of").alias("node"), F.col("into").alias("prev"), "size")
    start = piece.select("node", F.coalesce("prev", "node").alias("jump"), F.coalesce("size", F.lit(0)).cast("long").alias("dist"), F.col("prev").isNull().alias("done"))
    state, rings = _walk(cut(start, "start"))
    base = state.where("done").select(F.col("node").alias("id"), F.col("jump").alias("first"), F.col("dist").alias("base"), F.lit(None).cast("long").alias("around"))
    if not rings:
        return base
    of = state.where("not done").select("node")
    ring = sized(cut(piece.join(F.broadcast(of) if rings <= SMALL else shuffled(of), "node", "left_semi"), "rings"))
    behind = F.expr(f"transform(sequence(2, length(letters) - {graph.k} + 1), i -> substring(letters, i, {graph.k}))")
    own = graph.pairs.where("path").join(ring.select(F.col("node").alias("id")), "id", "left_semi").select(F.col("id").alias("node"), behind.alias("nodes"))
    own = cut(own.select("node", F.array_min("nodes").alias("least"), F.expr("array_position(nodes, array_min(nodes))").alias("at")), "least")
    roots = cut(_cycle_minimum(ring.join(own.select("node", "least"), "node"), rings), "roots")
    begin = own.join(roots, ["node", "least"]).select("node", "at")
    opened = ring.join(begin, "node", "left")
    again = opened.select("node", F.when(F.col("at").isNotNull(), F.col("node")).otherwise(F.col("prev")).alias("jump"), F.when(F.col("at").isNotNull(), 0).otherwise(F.col("size")).cast("long").alias("dist"), F.col("at").isNotNull().alias("done"))
    state, _ = _walk(cut(again, "start"))
    sizes = ring.join(roots, "node").groupBy("least").agg(F.sum("size").alias("around"))
    turned = state.select("node", "jump", "dist").join(begin.select(F.col("node").alias("jump"), "at"), "jump").join(roots, "node").join(sizes, "least")
    return base.unionByName(turned.select(F.col("node").alias("id"), F.col("jump").alias("first"), (F.col("dist") - F.col("at") + F.col("around")).alias("base"), "around"))


def _placed_nodes(graph: ReadGraph) -> DataFrame:
    """(kmer, after, u, ordinal, last, n, e) of a read graph: whole paths are placed, and nodes are numbered with their places."""
    k = graph.k
    ends = graph.ends
    places = settled(lambda: _read_places(graph, ends), "placed")
    heads = ends.where("into is null").select("kmer", "after", "out_of")
    # a cycle begins at its smallest node, which is a window of its first path or that path's end
    around = sized(cut(places.where("around is not null and id = first"), "around"))
    least = graph.pairs.join(around, "id").select("id", F.expr(f"substring(letters, cast(1 + around - base as int), {k})").alias("kmer"))
    named = heads.select("kmer", "after", "out_of").unionByName(least.select("kmer", F.lit(None).cast("string").alias("after"), F.col("id").alias("out_of")))
    named = ranked(named, ["kmer"], "u")
    of = named.where("out_of is not null").select(F.col("out_of").alias("first"), "u")
    placed = sized(cut(places.join(shuffled(of), "first").select("id", "u", "base", "around"), "placed"))

    def at(step: Column) -> Column:
        return F.when(F.col("around").isNull(), F.col("base") + step).otherwise((F.col("base") + step) % F.col("around"))

    inner = graph.inside(shuffled(graph.pairs.where("path").select("id", "letters")).join(placed, "id").drop("id"))
    inner = inner.select("kmer", "after", "u", at(F.col("step")).alias("ordinal"), F.coalesce(at(F.col("step")) == F.col("around") - 1, F.lit(False)).alias("last"))
    tails = shuffled(ends.where("into is not null").withColumnRenamed("into", "id")).join(placed, "id")
    tails = tails.select("kmer", "after", "u", at(F.col("size")).alias("ordinal"), F.coalesce(at(F.col("size")) == F.col("around") - 1, F.col("out_of").isNull()).alias("last"))
    firsts = named.where("after is not null").select("kmer", "after", "u", F.lit(0).cast("long").alias("ordinal"), F.col("out_of").isNull().alias("last"))
    return numbered_nodes(inner.unionByName(tails).unionByName(firsts))


WHOLE = "u long, sequence string, members array<long>, edges array<long>"


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WHOLE rows from members (u, ordinal, n, e, piece), sorted by u and ordinal; a row of ordinal -1 gives a unitig's number in n."""
    for table, first in whole_groups(batches):
        u, ordinal, n, e = (table[c].to_numpy() for c in ("u", "ordinal", "n", "e"))
        pieces = table["piece"].chunk(0)
        ends = np.append(first, len(u))
        begin = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        text = pa.StringArray.from_buffers(len(first), pa.py_buffer(begin[ends].copy()), pieces.buffers()[2])
        member = ordinal >= 0
        upto = np.append(0, np.cumsum(member))[ends].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x[member])) for x in (n, e)]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(member[first], u[first], n[first])), text, *lists], names=["u", "sequence", "members", "edges"])


class ReadUnitigs:
    """A :class:`Compacted` of a read graph, of which links, and unitigs with all that is read from them, are made when they are first asked for.

    Unitigs are numbered by the names of their heads, which numbers beyond six
    digits put in another order than the heads' letters do. Only heads are ranked
    again; nodes keep the number ``u`` that they were written with.
    """

    def __init__(self, graph: ReadGraph) -> None:
        self.k, self._nodes, self._order = graph.k, _placed_nodes(graph), None
        if (self._nodes.agg(F.max("n")).first()[0] or 0) > SIX_DIGITS:
            heads = self._nodes.where("ordinal = 0").select("u", numbered("n", "n").alias("head"))
            self._order = ranked(heads, ["head"], "named").select("u", "named")

    def written(self) -> ReadUnitigs:
        """The same, with unitigs and links made."""
        self._whole, self.links  # noqa: B018
        return self

    @cached_property
    def _whole(self) -> DataFrame:
        """(u, sequence, members, edges) of each unitig, written: the numbers of its members and of the edges before the first one out of each."""
        rows = self._nodes.select("u", "ordinal", "n", "e", F.when(F.col("ordinal") == 0, F.col("kmer")).otherwise(F.right("kmer", F.lit(1))).alias("piece"))
        if self._order is not None:
            # a unitig's number comes as one more row before its first member, so nodes are shuffled once
            rows = rows.unionByName(self._order.select("u", F.lit(-1).cast("long").alias("ordinal"), F.col("named").alias("n"), F.lit(0).cast("long").alias("e"), F.lit("").alias("piece")))
        return cut(rows.repartition("u").sortWithinPartitions("u", "ordinal").mapInArrow(_strung, WHOLE), "mapping")

    @property
    def unitigs(self) -> DataFrame:
        inside = F.expr("transform(slice(edges, 1, size(edges) - 1), x -> x + 1)")  # its only edge follows those of smaller nodes
        return self._whole.select(
            numbered("u", "u").alias("unitig_id"), "sequence", F.transform("members", lambda x: numbered("n", x)).alias("members"),
            F.transform(inside, lambda x: numbered("e", x)).alias("internal_edge_ids"), F.array_repeat(F.lit(self.k - 1), F.size("members") - 1).alias("internal_overlaps"),
        )

    @property
    def sizes(self) -> DataFrame:
        """(unitig_id, n, letters): how many members and letters, without naming them."""
        return self._whole.select(numbered("u", "u").alias("unitig_id"), F.size("members").alias("n"), F.length("sequence").alias("letters"))

    @property
    def mapping(self) -> DataFrame:
        return self._whole.select(F.posexplode("members").alias("ordinal", "n"), "u").select(numbered("n", "n").alias("node_id"), numbered("u", "u").alias("unitig_id"), "ordinal", F.lit(self.k).alias("length"))

    @property
    def internal(self) -> DataFrame:
        steps = F.expr("transform(sequence(1, size(members) - 1), i -> struct(edges[i - 1] + 1 as edge, members[i - 1] as source, members[i] as target))")
        return self._whole.where("size(members) > 1").select(F.explode(steps).alias("x")).select(numbered("e", "x.edge").alias("edge_id"), numbered("n", "x.source").alias("source"), numbered("n", "x.target").alias("target"), F.lit(self.k - 1).alias("overlap"))

    @cached_property
    def links(self) -> DataFrame:
        to = self._nodes.where("ordinal = 0").select(F.col("kmer").alias("_to"), F.col("u").alias("target"))
        rows = shuffled(outward(self._nodes.where("last"), "u")).join(to, "_to").select("edge", F.col("u").alias("source"), "target")
        for end in ("source", "target") if self._order is not None else ():
            rows = rows.join(shuffled(self._order.select(F.col("u").alias(end), "named")), end).drop(end).withColumnRenamed("named", end)
        rows = cut(rows, "edges")
        return rows.select(numbered("e", "edge").alias("link_id"), numbered("u", "source").alias("source"), numbered("u", "target").alias("target"), F.lit("++").alias("orientation"), F.lit(self.k - 1).alias("overlap"))


def compact(graph: Graph | ReadGraph) -> Compacted | ReadUnitigs:
    """Unitigs of the graph with a lossless mapping to its nodes and edges."""
    if isinstance(graph, ReadGraph):
        return ReadUnitigs(graph).written()
    nodes, located = graph.nodes if graph.exact else cut(graph.nodes, "nodes"), cut(graph.located, "edges")
    edges = located.drop("bucket", "junction") if graph.placed else located
    if not graph.exact:
        require_none(overlap_mismatches(nodes, edges), lambda r: f"edge {r['edge_id']}: the last {r['overlap']} letters of {r['source']} do not begin {r['target']}")
    if graph.placed:
        merge = _chains(located)
    else:
        merge = mergeable(edges).select("edge_id", "source", "target", "overlap", F.col("source").alias("head"), F.lit(1).alias("dist"), F.lit(True).alias("last"), F.lit(None).cast("string").alias("root"))
    behind, merge = _joined(cut(merge, "mergeable"))

    def named() -> DataFrame:
        of = nodes.select("node_id", "sequence", F.length("sequence").alias("length")).join(behind, "node_id", "left")
        of = of.select("node_id", "sequence", "length", F.coalesce("head", "node_id").alias("head"), F.coalesce("ordinal", F.lit(0)).cast("int").alias("ordinal"), "overlap", "edge_id")
        of = cut(of, "placed")
        heads = ranked(of.where("ordinal = 0").select("head"), ["head"]).select("head", numbered("u", "rank").alias("unitig_id"))
        return of.join(heads, "head").drop("head")

    of = settled(named, "mapping")
    mapping = of.select("node_id", "unitig_id", "ordinal", "length")

    pieces = of.select("unitig_id", "ordinal", "node_id", "edge_id", "overlap", F.expr("substring(sequence, coalesce(overlap, 0) + 1)").alias("piece"))
    # by stretches first, so that what is sorted at once stays small
    pieces = pieces.withColumn("part", F.expr(f"ordinal div {STRETCH}")).repartition("unitig_id")
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "node_id", "edge_id", "overlap", "piece")))
    parts = pieces.groupBy("unitig_id", "part").agg(rows.alias("p")).select("unitig_id", "part", F.array_join("p.piece", "").alias("letters"), F.col("p.node_id").alias("members"), F.col("p.edge_id").alias("edges"), F.col("p.overlap").alias("overlaps"))
    unitigs = parts.groupBy("unitig_id").agg(F.array_sort(F.collect_list(F.struct("part", "letters", "members", "edges", "overlaps"))).alias("p")).select(
        "unitig_id",
        F.array_join(F.col("p.letters"), "").alias("sequence"),
        F.flatten("p.members").alias("members"),
        F.expr("slice(flatten(p.edges), 2, greatest(size(flatten(p.edges)) - 1, 0))").alias("internal_edge_ids"),
        F.expr("slice(flatten(p.overlaps), 2, greatest(size(flatten(p.overlaps)) - 1, 0))").alias("internal_overlaps"),
    )
    at = mapping.select("node_id", "unitig_id")
    links = (
        edges.join(merge.select("edge_id"), "edge_id", "left_anti")
        .join(at.select(F.col("node_id").alias("source"), F.col("unitig_id").alias("from_unitig")), "source")
        .join(at.select(F.col("node_id").alias("target"), F.col("unitig_id").alias("to_unitig")), "target")
        .select(F.col("edge_id").alias("link_id"), F.col("from_unitig").alias("source"), F.col("to_unitig").alias("target"), "orientation", "overlap")
    )
    return Compacted(mapping, unitigs, links, merge.select("edge_id", "source", "target", "overlap"))


def sequence_pieces(unitigs: DataFrame, size: int = STRETCH) -> DataFrame:
    """(unitig_id, piece, letters): stretches of ``2 * size`` letters that begin every ``size`` letters, so that up to ``size`` letters from anywhere are in one."""
    n = F.greatest((F.length("sequence") - 1) / size, F.lit(0)).cast("int")
    each = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("piece"), F.substring("sequence", i * size + 1, F.lit(2 * size)).alias("letters")))
    return unitigs.select("unitig_id", F.explode(each).alias("p")).select("unitig_id", "p.*")


def member_sequences(c: Compacted, size: int = STRETCH) -> DataFrame:
    """(node_id, sequence) of all members, read from the stretches of their unitigs."""
    if c.k is not None:
        each = F.transform(F.sequence(F.lit(1), F.size("members"), F.lit(size)), lambda i: F.struct(F.slice("members", i, F.lit(size)).alias("members"), F.substring("sequence", i, F.lit(size + c.k - 1)).alias("letters")))
        parts = c.unitigs.select(F.explode(each).alias("p")).select("p.*")
        return parts.select(F.explode(F.arrays_zip(F.col("members").alias("node_id"), seq.kmers(F.col("letters"), c.k).alias("sequence"))).alias("x")).select("x.*")
    joint = c.internal.select(F.col("target").alias("node_id"), F.col("overlap").alias("joint"))
    rows = c.mapping.join(joint, "node_id", "left").withColumn("joint", F.when(F.col("ordinal") > 0, F.col("joint")).otherwise(0))
    rows = running(rows, "unitig_id", "ordinal", F.col("length") - F.coalesce("joint", F.lit(0)), "end").select("node_id", "unitig_id", "length", (F.col("end") - F.col("length")).cast("int").alias("start"))
    rows = cut(rows, "starts")
    pieces = cut(sequence_pieces(c.unitigs, size), "letters")
    short = rows.where(F.col("length") <= size).withColumn("piece", F.expr(f"cast(start div {size} as int)")).join(pieces, ["unitig_id", "piece"])
    short = short.select("node_id", F.expr(f"substring(letters, start - piece * {size} + 1, length)").alias("sequence"))
    long = rows.where(F.col("length") > size).select("*", F.explode(F.expr(f"sequence(cast(start div {size} as int), cast((start + length - 1) div {size} as int))")).alias("piece"))
    part = F.expr(f"substring(left(letters, {size}), greatest(start - piece * {size}, 0) + 1, start + length - greatest(start, piece * {size}))")
    long = long.join(pieces, ["unitig_id", "piece"]).select("node_id", "piece", part.alias("part"))
    long = long.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("piece", "part"))).alias("p")).select("node_id", F.array_join("p.part", "").alias("sequence"))
    return short.unionByName(long)


def expand(c: Compacted) -> Expanded:
    """The original nodes and edges from unitigs, mapping, links and the edges inside unitigs."""
    inner = c.internal.select("edge_id", "source", "target", F.lit("++").alias("orientation"), "overlap")
    ends = c.unitigs.select("unitig_id", F.element_at("members", 1).alias("head"), F.element_at("members", -1).alias("tail"))
    outer = (
        c.links.join(ends.select(F.col("unitig_id").alias("source"), "tail"), "source").join(ends.select(F.col("unitig_id").alias("target"), "head"), "target")
        .select(F.col("link_id").alias("edge_id"), F.col("tail").alias("source"), F.col("head").alias("target"), F.coalesce("orientation", F.lit("++")).alias("orientation"), "overlap")
    )
    return Expanded(c, inner.unionByName(outer))


class Expanded:
    """A :class:`Graph` of given edges whose nodes are read from their unitigs when they are first asked for."""

    kind, k, exact, placed = "de_bruijn", None, False, False

    def __init__(self, c: Compacted, edges: DataFrame) -> None:
        self._of, self.edges = c, edges

    @cached_property
    def nodes(self) -> DataFrame:
        return member_sequences(self._of)

    @property
    def located(self) -> DataFrame:
        return self.edges
