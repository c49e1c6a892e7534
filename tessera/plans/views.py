"""Derived inputs of the catalogue, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.seq import LETTERS, encode
from tessera.operators.build import Graph, consecutive, de_bruijn
from tessera.plans import table

CYCLIC = "".join("ACGT"[i % 4] for i in range(26))


def encoded_sql(column: str) -> str:
    return f"translate(upper(regexp_replace({column}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{CYCLIC}')"


def rc_sql(s: str) -> str:
    return f"reverse(translate({s}, 'ACGTN', 'TGCAN'))"


def doc_seqs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, sample_id, seq): whole documents as sequences."""
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("sample_id"), encode(F.coalesce("text", F.lit(""))).alias("seq"))


DOC_SEQS = f"seqs AS (SELECT doc_id, source AS sample_id, {encoded_sql('coalesce(text, chr(32))')} AS seq FROM documents)"


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(read_id, sample_id, seq): whole conversation turns as reads, the role as sample."""
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws("_", "conv_id", "turn").alias("read_id"), F.col("role").alias("sample_id"), encode(F.coalesce("text", F.lit(""))).alias("seq"))


READS = f"reads AS (SELECT conv_id || '_' || turn AS read_id, role AS sample_id, {encoded_sql('coalesce(text, chr(32))')} AS seq FROM conversations)"


def kmers_sql(k: int, name: str = "kmers") -> str:
    return f"{name} AS (SELECT read_id, sample_id, i, substr(seq, i, {k}) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS i FROM reads WHERE length(seq) >= {k}))"


def graph_sql(k: int) -> str:
    """CTEs nodes(node_id, kmer) and edges(edge_id, source, target) of the reads' de Bruijn graph."""
    return (
        f"{READS}, {kmers_sql(k)}, {kmers_sql(k + 1, 'pairs_')}, "
        "nodes AS MATERIALIZED (SELECT printf('n%06d', row_number() OVER (ORDER BY kmer)) AS node_id, kmer FROM (SELECT DISTINCT kmer FROM kmers)), "
        f"pairs AS (SELECT DISTINCT left(kmer, {k}) AS l, right(kmer, {k}) AS r FROM pairs_), "
        "edges AS MATERIALIZED (SELECT printf('e%06d', row_number() OVER (ORDER BY l, r)) AS edge_id, a.node_id AS source, b.node_id AS target FROM pairs JOIN nodes a ON a.kmer = l JOIN nodes b ON b.kmer = r)"
    )


def read_graph(spark: SparkSession, d: str, k: int) -> Graph:
    return de_bruijn(reads(spark, d), k)


#: CTEs of the compacted graph: heads and cycle roots, then one step of the path at a time.
UNITIGS = """outd AS (SELECT source, count(*) AS n FROM edges GROUP BY 1), ind AS (SELECT target, count(*) AS n FROM edges GROUP BY 1),
merging AS (SELECT e.* FROM edges e JOIN outd USING (source) JOIN ind USING (target) WHERE outd.n = 1 AND ind.n = 1 AND source <> target),
headed AS (SELECT node_id AS head FROM nodes ANTI JOIN merging ON node_id = target),
walk AS (SELECT head, head AS node, 0 AS ordinal FROM headed UNION ALL SELECT head, target, ordinal + 1 FROM walk JOIN merging ON source = node),
ringed AS (SELECT node_id AS node FROM nodes ANTI JOIN walk ON node_id = node),
around AS (SELECT node AS root, node, 0 AS ordinal FROM ringed UNION ALL SELECT root, target, ordinal + 1 FROM around JOIN merging ON source = node WHERE target <> root),
roots AS (SELECT root FROM around GROUP BY root HAVING min(node) = root),
placed AS (SELECT head, node, ordinal FROM walk UNION ALL SELECT root, node, ordinal FROM around WHERE root IN (SELECT root FROM roots)),
named AS (SELECT head, printf('u%06d', row_number() OVER (ORDER BY head)) AS unitig_id FROM (SELECT DISTINCT head FROM placed)),
mapping AS MATERIALIZED (SELECT node AS node_id, unitig_id, ordinal FROM placed JOIN named USING (head)),
absorbed AS MATERIALIZED (SELECT * FROM merging ANTI JOIN roots ON target = root)"""


def hops(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, source, target): successive suppliers of an order's lines."""
    order = ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return consecutive(table(spark, d, "lineitem"), "l_orderkey", order, "l_suppkey")


HOPS = """hops AS (SELECT * FROM (SELECT l_orderkey, l_suppkey AS source, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS target FROM lineitem) WHERE target IS NOT NULL AND source <> target),
g_edges AS (SELECT DISTINCT source, target FROM hops)"""


def supplier_edges(spark: SparkSession, d: str) -> DataFrame:
    return hops(spark, d).select("source", "target").distinct()


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """(taxon_id, parent_id, rank): customers as species, nations as genera, regions as families under one root."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = [
        r.select((F.col("r_regionkey").cast("long") + 2).alias("taxon_id"), F.lit(1).cast("long").alias("parent_id"), F.lit("family").alias("rank")),
        n.select((F.col("n_nationkey").cast("long") + 100).alias("taxon_id"), (F.col("n_regionkey").cast("long") + 2).alias("parent_id"), F.lit("genus").alias("rank")),
        c.select((F.col("c_custkey") + 1000).alias("taxon_id"), (F.col("c_nationkey").cast("long") + 100).alias("parent_id"), F.lit("species").alias("rank")),
    ]
    root = spark.range(1).select(F.lit(1).cast("long").alias("taxon_id"), F.lit(1).cast("long").alias("parent_id"), F.lit("root").alias("rank"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(root)


TAXONOMY = """taxonomy AS (SELECT r_regionkey::BIGINT + 2 AS taxon_id, 1::BIGINT AS parent_id, 'family' AS rank FROM region
UNION ALL SELECT n_nationkey::BIGINT + 100, n_regionkey::BIGINT + 2, 'genus' FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey::BIGINT + 100, 'species' FROM customer UNION ALL SELECT 1, 1, 'root')"""
