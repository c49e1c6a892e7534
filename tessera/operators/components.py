"""Connected components by alternating neighbour minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut, settled

#: Edges that a task holds at a time.
CHUNK = 1 << 20


def forest(edges: DataFrame) -> DataFrame:
    """(src, dst) with the components of ``edges`` (src, dst): of every stretch of a task's edges one for each node, to the first node of its component there.

    Where nodes have many edges most of them go before anything is shuffled.
    """
    kind = dict(edges.dtypes)["src"]

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        both = pa.concat_arrays([table[c].combine_chunks() for c in ("src", "dst")]).dictionary_encode()
        code, n = both.indices.to_numpy(), table.num_rows
        a, b, root = code[:n], code[n:], np.arange(len(both.dictionary))
        while True:
            u, v = root[a], root[b]
            far = u != v
            if not far.any():
                break
            a, b, u, v = a[far], b[far], u[far], v[far]
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while not (root[root] == root).all():
                root = root[root]
        others = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(others)), both.dictionary.take(pa.array(root[others]))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            held.append(batch)
            total += batch.num_rows
            if total >= CHUNK:
                yield solve(held)
                held, total = [], 0
        if held:
            yield solve(held)

    whole = edges.select("src", "dst").where("src is not null and dst is not null")
    return whole.mapInArrow(run, f"src {kind}, dst {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``.

    Alternates two contractions until nothing changes. *Large star* hangs every
    larger neighbour of a node on the node's smallest neighbour; *small star*
    does the same with the smaller neighbours. Each is one grouped minimum and
    one join, no adjacency list is ever gathered, and the number of rounds is
    logarithmic in the diameter. Nodes that appear in no edge are not returned;
    self loops and null ends are ignored.
    """
    return settled(lambda: _contracted(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")), "components")


def _contracted(e: DataFrame) -> DataFrame:
    cur = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        large = _large_star(cur)
        small = cut(_small_star(large), "cc")
        state = small.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        cur = small
        if state == before:
            break
        before = state
    return (
        cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    )


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
