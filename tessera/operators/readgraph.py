"""De Bruijn graphs of reads, kept as paths of letters until their nodes are asked for.

Minimisers' tasks join windows to paths (:func:`tessera.operators.kmers.paths`).
A node carries the letters that follow it, so edges are numbered by a running sum
over the nodes in order and are never sorted themselves; a node of a compacted
graph also carries its unitig and its place there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.cut import cut, settled, shuffled
from tessera.operators.ids import numbered, ranked
from tessera.operators.kmers import strings, paths
from tessera.operators.runs import whole_groups


#: Windows that a task hands on at a time.
STRETCH = 1 << 16


class ReadGraph:
    """nodes (node_id, sequence) and edges (edge_id, source, target, orientation, overlap), made when they are first asked for."""

    kind, exact, placed = "de_bruijn", True, False

    def __init__(self, reads: DataFrame, k: int) -> None:
        self.k = k
        self.pairs = settled(lambda: paths(reads, k).withColumn("id", F.monotonically_increasing_id()), "pairs")
        self._alone = reads.where(F.length("seq") == k).select(F.col("seq").alias("kmer")).distinct()

    @cached_property
    def ends(self) -> DataFrame:
        """(kmer, after, into, size, out_of): the k letters at the ends of rows, the letters that follow, the path (and its steps) that ends there and the path that begins there; written."""
        k, none = self.k, F.lit(None).cast("long")
        path = F.when(F.col("path"), F.col("id"))
        first = self.pairs.select(F.left("letters", F.lit(k)).alias("kmer"), F.substring("letters", k + 1, 1).alias("after"), none.alias("into"), none.alias("size"), path.alias("out_of"))
        last = self.pairs.select(F.right("letters", F.lit(k)).alias("kmer"), F.lit(None).cast("string").alias("after"), path.alias("into"), F.when(F.col("path"), F.length("letters") - k).cast("long").alias("size"), none.alias("out_of"))
        both = first.unionByName(last)

        def rows() -> DataFrame:
            # reads of exactly k letters are nodes by themselves where no path holds them; written, so that few are not met by shuffling all windows
            alone = cut(self._alone, "alone")
            every = both
            if not alone.isEmpty():
                held = self.inside(self.pairs.select("letters")).select("kmer").join(alone, "kmer", "left_semi").distinct()
                every = both.unionByName(alone.join(shuffled(held), "kmer", "left_anti").select("kmer", F.lit(None).cast("string").alias("after"), none.alias("into"), none.alias("size"), none.alias("out_of")))
            return every.repartition("kmer").sortWithinPartitions("kmer", "after").mapInArrow(_met, "kmer string, after string, into long, size long, out_of long")

        return settled(rows, "mergeable")

    def inside(self, rows: DataFrame) -> DataFrame:
        """rows (..., letters) with ``step``, ``kmer`` and ``after`` for each window of k letters that is neither first nor last."""
        k, rest = self.k, [c for c in rows.columns if c != "letters"]
        names = [*rest, "step", "kmer", "after"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(0).cast(pa.large_string())
                begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                n = np.maximum(np.diff(begin) - k - 1, 0)
                upto = np.cumsum(n)
                for at in range(0, int(n.sum()), STRETCH):
                    i = np.arange(at, min(at + STRETCH, int(upto[-1])))
                    row = np.searchsorted(upto, i, side="right")
                    step = i - (upto[row] - n[row]) + 1
                    place = begin[row] + step
                    letters = np.frombuffer(texts.buffers()[2], np.uint8)
                    kmers = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(letters, k)[place]).view(f"S{k}").ravel()
                    of = [c.take(pa.array(row)) for c in batch.columns[1:]]
                    yield pa.RecordBatch.from_arrays([*of, pa.array(step), strings(kmers), strings(letters[place + k].view("S1"))], names=names)

        kinds = dict(rows.dtypes)
        return rows.where(F.length("letters") > k + 1).select("letters", *rest).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "step long, kmer string, after string"]))

    @cached_property
    def numbers(self) -> DataFrame:
        return numbered_nodes(self.ends.select("kmer", "after").unionByName(self.inside(self.pairs.select("letters")).select("kmer", "after")))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.numbers.select(numbered("n", "n").alias("node_id"), F.col("kmer").alias("sequence"))

    @cached_property
    def edges(self) -> DataFrame:
        rows = shuffled(outward(self.numbers, "n")).join(self.numbers.select(F.col("kmer").alias("_to"), F.col("n").alias("target")), "_to")
        return rows.select(numbered("e", "edge").alias("edge_id"), numbered("n", "n").alias("source"), numbered("n", "target").alias("target"), F.lit("++").alias("orientation"), F.lit(self.k - 1).alias("overlap"))

    @property
    def motifs(self) -> DataFrame:
        """(edge_id, motif): the k + 1 letters across each edge, which a node and the letter that follows it are."""
        return outward(self.numbers, "kmer").select(numbered("e", "edge").alias("edge_id"), F.concat("kmer", F.right("_to", F.lit(1))).alias("motif"))

    @property
    def located(self) -> DataFrame:
        return self.edges


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each kmer from rows (kmer, after, into, size, out_of), sorted by kmer and after: the letters in order, and what is there of the numbers."""
    for table, first in whole_groups(batches):
        letters = pc.fill_null(table["after"].chunk(0), "")
        begin = np.frombuffer(letters.buffers()[1], np.int32)[letters.offset : letters.offset + len(letters) + 1]
        after = pa.StringArray.from_buffers(len(first), pa.py_buffer(begin[np.append(first, len(letters))].copy()), letters.buffers()[2])
        most = [np.maximum.reduceat(pc.fill_null(table[c], -1).to_numpy(), first) for c in ("into", "size", "out_of")]
        yield pa.RecordBatch.from_arrays([table["kmer"].chunk(0).take(pa.array(first)), after, *[pa.array(x, mask=x < 0) for x in most]], names=table.column_names)


def numbered_nodes(rows: DataFrame) -> DataFrame:
    """rows (kmer, after, ...) with ``n``, the rank by kmer from 1 on, and ``e``, the number of edges out of smaller nodes; written."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = edges = 0
        for batch in batches:
            out = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
            sums = np.cumsum(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(nodes + 1, nodes + len(out) + 1)), pa.array(edges + sums - out)], names=[*batch.schema.names, "i", "before"])
            nodes, edges = nodes + len(out), edges + int(out.sum())

    dealt = rows.select("kmer", "after", *[c for c in rows.columns if c not in ("kmer", "after")]).repartitionByRange(parts, "kmer").sortWithinPartitions("kmer").withColumn("part", F.spark_partition_id())
    order = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
    dealt = cut(dealt.mapInArrow(run, f"{order}, i long, before long"), "ranked")
    sums = dealt.groupBy("part").agg(F.count("*").alias("_n"), F.sum(F.length("after")).cast("long").alias("_e"))
    w = Window.orderBy("part")  # one row for each task
    sums = sums.select("part", (F.sum("_n").over(w) - F.col("_n")).alias("_n"), (F.sum("_e").over(w) - F.col("_e")).alias("_e"))
    out = dealt.join(F.broadcast(sums), "part")
    return out.select(*[c for c in dealt.columns if c not in ("part", "i", "before")], (F.col("_n") + F.col("i")).alias("n"), (F.col("_e") + F.col("before")).alias("e"))


def outward(nodes: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, edge, _to): the edges out of nodes (kmer, after, e), numbered from 1 on, with the letters of their target."""
    letters = F.expr("transform(sequence(1, length(after)), i -> substring(after, i, 1))")
    each = nodes.where("after <> ''").select(*dict.fromkeys([*keep, "kmer"]), "e", F.posexplode(letters).alias("_at", "_letter"))
    return each.select(*keep, (F.col("e") + F.col("_at") + 1).alias("edge"), F.expr("concat(substring(kmer, 2), _letter)").alias("_to"))
