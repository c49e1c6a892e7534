"""Queries over functions, rules, layouts, learning and transit, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cut import cut, shuffled, sized
from tessera.functions import seq
from tessera.operators import annotate, build, colour, edits, identity, ml, tensor, transit, validate
from tessera.operators.annotate import PROVENANCE, Layers, attach
from tessera.operators.compact import Compacted, compact, overlap_mismatches
from tessera.operators.ids import ranked
from tessera.operators.kmers import sample_counts
from tessera.operators.layout_rules import layout_violations
from tessera.operators.proposals import application_violations, apply_proposal
from tessera.operators.spacing import nearest_neighbour_ratio
from tessera.operators.topology import csr_slots, pointers
from tessera.operators.versions import Version, apply_batch
from tessera.plans import table
from tessera.plans.catalogue import K, _as_links, registry
from tessera.plans.views import DOC_SEQS, HOPS, READS, UNITIGS, doc_seqs, encoded_sql, graph_sql, rc_sql, read_graph, reads, supplier_edges

query = registry.add


def base4_sql(x: str, n: int) -> str:
    return f"array_to_string(list_transform(range({n - 1}, -1, -1), lambda p: substr('ACGT', 1 + (({x})::HUGEINT // (4::HUGEINT ** p)::HUGEINT % 4)::INT, 1)), '')"


# Functions ------------------------------------------------------------------


@query("seq_blocks", f"""SELECT s_suppkey, {base4_sql('s_suppkey', 10)} AS block, (SELECT string_agg(c, '') FROM (SELECT unnest(list_reverse(string_split(ltrim({base4_sql('s_suppkey + 1', 16)}, 'A'), ''))) AS c)) AS tag FROM supplier""")
def seq_blocks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", seq.base4(k, 10).alias("block"), seq.base4_tag(k).alias("tag"))


@query("seq_names", """SELECT o_orderkey, 'GCF_' || o_custkey AS accession, 'GCF' AS genome, 'sample_' || o_custkey AS sample, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 0.5 END AS coverage,
CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS k, printf('%.10f', o_totalprice) AS cell, lower(o_orderpriority) AS place, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS number FROM orders""")
def seq_names(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c, even = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 2 == 0
    return o.select(
        "o_orderkey", seq.accession(F.concat(F.lit("GCF_"), c, F.lit("_7/1"))).alias("accession"), seq.read_genome(F.concat(F.lit("GCF_"), c)).alias("genome"),
        seq.file_sample(F.concat(c, F.lit("_full_R1.fastq"))).alias("sample"), seq.header_coverage(F.when(even, F.concat(F.lit("k21_3 flag=1 multi="), c, F.lit(".5 len=9"))).otherwise("k21_3 len=9")).alias("coverage"),
        seq.contig_k(F.concat(F.lit("out/k"), c, F.when(F.col("o_orderkey") % 3 == 0, ".contigs.fa").otherwise(".final.contigs.fa"))).alias("k"), seq.float_cell(F.col("o_totalprice")).alias("cell"),
        seq.place_key(F.concat(F.lit("  "), F.regexp_replace("o_orderpriority", " ", "\t "))).alias("place"), seq.route_number(F.when(even, F.concat(F.lit("bus:"), c, F.lit("a"))).otherwise("bus:a1")).alias("number"),
    )


@query("seq_even_share", "SELECT l_orderkey, round(100.0 * count(*) FILTER (l_partkey % 2 = 0) / count(*), 6) AS share FROM lineitem GROUP BY 1")
def seq_even_share(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("r:"), F.col("l_partkey").cast("string"))).alias("v"))
    return r.select("l_orderkey", F.round(seq.even_share(F.col("v")), 6).alias("share"))


@query("seq_digest", "SELECT doc_id, sha256(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))) AS digest FROM documents")
def seq_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", seq.letters_digest(F.coalesce("text", F.lit(""))).alias("digest"))


PARTS = f"p AS (SELECT p_partkey, {encoded_sql('p_name')} AS a, {encoded_sql('p_type')} AS b FROM part)"


@query("seq_covers", f"""WITH {PARTS}, q AS (SELECT *, substr(a, 3, 4) AS r FROM p) SELECT p_partkey, contains(a, r) OR contains(a, {rc_sql('r')}) AS part_of,
CASE WHEN length(b) < length(a) THEN contains(a, b) OR contains(a, {rc_sql('b')}) ELSE contains(b, a) OR contains({rc_sql('b')}, a) END AS either, right(a, 2) = left(b, 2) AS fits FROM q""")
def seq_covers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", seq.encode(F.col("p_name")).alias("a"), seq.encode(F.col("p_type")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return p.select("p_partkey", seq.covers(a, F.substring(a, 3, 4)).alias("part_of"), seq.covers(a, b).alias("either"), seq.overlaps(a, b, F.lit(2)).alias("fits"))


# Rules ----------------------------------------------------------------------


@query("overlap_mismatches", f"WITH {HOPS}, s AS (SELECT s_suppkey, {base4_sql('s_suppkey', 12)} AS seq FROM supplier) SELECT source || '>' || target AS edge_id FROM g_edges JOIN s a ON a.s_suppkey = source JOIN s b ON b.s_suppkey = target WHERE right(a.seq, 1) <> left(b.seq, 1)")
def overlap_mismatch_rows(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), seq.base4(F.col("s_suppkey"), 12).alias("sequence"))
    e = supplier_edges(spark, d).select(F.concat_ws(">", "source", "target").alias("edge_id"), "source", "target", F.lit("++").alias("orientation"), F.lit(1).alias("overlap"))
    return overlap_mismatches(nodes, e).select("edge_id")


def _damaged(spark: SparkSession, d: str) -> Compacted:
    """Suppliers as unitigs of two members: some sequences, places, lengths and link ends are wrong."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    member = lambda n: F.concat(F.lit("m"), k.cast("string"), F.lit(n))
    unitigs = s.where("s_suppkey % 10 <> 9").select(
        k.cast("string").alias("unitig_id"), F.when(k % 10 == 1, "ACX").otherwise("ACGTACGT").alias("sequence"), F.array(member("a"), member("b")).alias("members"),
        F.when(k % 10 == 2, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("i"), k.cast("string")))).alias("internal_edge_ids"), F.array(F.lit(2)).alias("internal_overlaps"),
    )
    rows = s.select(k, F.posexplode(F.array(member("a"), member("b"))).alias("place", "node_id"))
    mapping = rows.select("node_id", k.cast("string").alias("unitig_id"), F.when(k % 10 == 3, 0).otherwise(F.col("place")).alias("ordinal"), F.when(k % 10 == 4, 6).otherwise(5).alias("length"))
    e = supplier_edges(spark, d)
    links = e.select(F.concat_ws(">", "source", "target").alias("link_id"), F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.when(F.col("source") % 10 == 5, "+?").otherwise("++").alias("orientation"), F.lit(None).cast("int").alias("overlap"))
    return Compacted(mapping, unitigs, links, spark.createDataFrame([], "edge_id string, source string, target string, overlap int"))


@query("validate_compacted", f"""WITH {HOPS}, s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 2::BIGINT AS rule, k::VARCHAR AS at FROM s WHERE k % 10 = 1 UNION ALL SELECT 5, k::VARCHAR FROM s WHERE k % 10 = 2
UNION ALL SELECT 11, source || '>' || target FROM g_edges WHERE source % 10 = 9 OR target % 10 = 9 UNION ALL SELECT 12, source || '>' || target FROM g_edges WHERE source % 10 = 5
UNION ALL SELECT 16, 'm' || k || x FROM s, (VALUES ('a'), ('b')) v(x) WHERE k % 10 = 9 UNION ALL SELECT 19, 'm' || k || 'b' FROM s WHERE k % 10 = 3
UNION ALL SELECT 20, k::VARCHAR FROM s WHERE k % 10 IN (1, 4)""")
def validate_compacted(spark: SparkSession, d: str) -> DataFrame:
    return validate.compacted_violations({"schema_version": "1.0", "graph_type": "repeat"}, _damaged(spark, d)).select(F.col("rule").cast("long").alias("rule"), "at")


TABLE_META = {"schema_version": "1.0", "graph_id": "s", "graph_type": "repeat", "features": {"node": {"coverage": "float", "label": "label"}, "edge": {"color_set": "color_set"}}}


@query("validate_tables", f"""WITH {HOPS}, s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 11::BIGINT AS rule, (k + 1000000)::VARCHAR AS at FROM s WHERE k % 4 = 0 UNION ALL SELECT 12, k::VARCHAR FROM s WHERE k % 5 = 1
UNION ALL SELECT 16, k::VARCHAR FROM s WHERE k % 3 = 2 UNION ALL SELECT 17, source || '>' || target FROM g_edges WHERE target % 7 IN (3, 4, 5, 6)""")
def validate_tables(spark: SparkSession, d: str) -> DataFrame:
    """Cells that are no numbers, sequences without a node, labels and colours without an entry."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    nodes = s.select(k.cast("string").alias("node_id"), F.when(k % 5 == 1, "much").otherwise("1.5").alias("coverage"), (k % 3).cast("string").alias("label"))
    sequences = s.select(k.cast("string").alias("id"), F.lit("ACGT").alias("seq")).unionByName(s.where("s_suppkey % 4 = 0").select((k + 1000000).cast("string").alias("id"), F.lit("ACGT").alias("seq")))
    edges = supplier_edges(spark, d).select(F.concat_ws(">", "source", "target").alias("edge_id"), F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.concat(F.lit("0, "), (F.col("target") % 7).cast("string")).alias("color_set"))
    colors = spark.range(3).select(F.col("id").cast("string").alias("color_id"), F.lit("n").alias("namespace"), F.lit("v").alias("value"))
    labels = spark.range(2).select(F.col("id").cast("string").alias("label_id"), F.lit("n").alias("namespace"), F.lit("v").alias("value"))
    return validate.table_violations(TABLE_META, nodes, sequences, edges, colors, labels).select(F.col("rule").cast("long").alias("rule"), "at")


@query("leaking_namespaces", "SELECT DISTINCT n AS namespace FROM (SELECT CASE c_custkey % 6 WHEN 0 THEN 'Truth' WHEN 1 THEN 'gold' WHEN 2 THEN 'TARGET' WHEN 3 THEN 'expected_action' WHEN 4 THEN 'genome' ELSE 'answer' END AS n FROM customer) WHERE n IN ('Truth', 'gold', 'TARGET', 'expected_action')")
def leaking_namespaces(spark: SparkSession, d: str) -> DataFrame:
    n = F.element_at(F.array(*map(F.lit, ("Truth", "gold", "TARGET", "expected_action", "genome", "answer"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return validate.leaking_namespaces(table(spark, d, "customer").select(n.alias("namespace")))


@query("layout_violations", f"""WITH {HOPS}, ids AS (SELECT DISTINCT source AS k FROM g_edges UNION SELECT target FROM g_edges), n AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS dense_id FROM ids)
SELECT 2::BIGINT AS rule, 'twice' AS at WHERE (SELECT count(*) FROM n WHERE dense_id % 5 = 0) > 1 UNION ALL SELECT 6, dense_id::VARCHAR FROM n WHERE dense_id % 4 = 1 UNION ALL SELECT 7, dense_id::VARCHAR FROM n WHERE dense_id % 4 = 2""")
def layout_violation_rows(spark: SparkSession, d: str) -> DataFrame:
    """A layout with repeated names, vectors of another width and masks that are not 0 or 1."""
    e = supplier_edges(spark, d).withColumn("link_id", F.concat_ws(">", "source", "target"))
    ids = tensor.dense_ids(e.select(F.explode(F.array("source", "target")).alias("node_id")).distinct(), "node_id")
    slots, i = csr_slots(e, ids), F.col("dense_id")
    nodes = ids.select("dense_id", F.when(i % 5 == 0, "twice").otherwise(F.col("node_id").cast("string")).alias("node_id"), F.when(i % 4 == 1, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("features"), F.array(F.when(i % 4 == 2, 2).otherwise(1)).alias("colors"))
    return layout_violations(nodes, slots.select("slot", "src", "dst"), pointers(slots, ids, "src")).select(F.col("rule").cast("long").alias("rule"), "at")


@query("mapping_differences", "SELECT o_custkey::VARCHAR AS unitig_id FROM orders GROUP BY 1 HAVING count(*) > 1")
def mapping_differences(spark: SparkSession, d: str) -> DataFrame:
    """A mapping against itself with the members in reverse."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("unitig_id"), F.col("o_orderkey").cast("string").alias("node_id"), F.col("o_orderkey").alias("ordinal"))
    return identity.mapping_differences(o, o.withColumn("ordinal", -F.col("ordinal"))).select("unitig_id")


# Layouts --------------------------------------------------------------------

U = f"u AS (SELECT unitig_id, row_number() OVER (ORDER BY unitig_id) - 1 AS dense_id, count(*) AS n FROM mapping GROUP BY 1)"
LINKS_SQL = "links AS (SELECT e.edge_id AS link_id, a.unitig_id AS source, b.unitig_id AS target FROM (SELECT * FROM edges ANTI JOIN absorbed USING (edge_id)) e JOIN mapping a ON a.node_id = e.source JOIN mapping b ON b.node_id = e.target)"


def _layout(spark: SparkSession, d: str) -> tuple[Compacted, tensor.Layout]:
    c = compact(read_graph(spark, d, K))
    sizes = sized(cut(c.sizes, "sizes"))
    n = sizes.select("unitig_id", F.array(F.col("n").cast("float"), F.col("letters").cast("float")).alias("features"))
    e = c.links.select("link_id", F.array(F.col("overlap").cast("float")).alias("features"))
    return c, tensor.layout(c, n, e, labels=sizes.select("unitig_id", (F.col("n") % 3).alias("label")))


@query("layout_nodes", f"WITH RECURSIVE {graph_sql(K)}, {UNITIGS}, {U} SELECT dense_id, unitig_id AS source_id, n::DOUBLE AS f0, (n + {K} - 1)::DOUBLE AS f1, n % 3 AS label FROM u")
def layout_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = _layout(spark, d)[1].rows
    return n.select("dense_id", "source_id", F.col("features")[0].cast("double").alias("f0"), F.col("features")[1].cast("double").alias("f1"), "label")


@query("layout_slots", f"WITH RECURSIVE {graph_sql(K)}, {UNITIGS}, {U}, {LINKS_SQL} SELECT row_number() OVER (ORDER BY a.dense_id, b.dense_id, link_id) - 1 AS slot, a.dense_id AS src, b.dense_id AS dst, link_id, {K - 1}::DOUBLE AS f0 FROM links JOIN u a ON a.unitig_id = source JOIN u b ON b.unitig_id = target")
def layout_slots(spark: SparkSession, d: str) -> DataFrame:
    return _layout(spark, d)[1].slots.select("slot", "src", "dst", "link_id", F.col("features")[0].cast("double").alias("f0"))


@query("resolved_sequences", f"""WITH RECURSIVE {graph_sql(K)}, {UNITIGS}, {U} SELECT dense_id, unitig_id AS source_id, md5(string_agg(CASE WHEN ordinal = 0 THEN kmer ELSE right(kmer, 1) END, '' ORDER BY ordinal)) AS seq_md5
FROM mapping JOIN nodes USING (node_id) JOIN u USING (unitig_id) WHERE dense_id % 2 = 0 GROUP BY 1, 2""")
def resolved_sequences(spark: SparkSession, d: str) -> DataFrame:
    c, g = _layout(spark, d)
    return tensor.resolved(g.rows, c.unitigs, g.rows.where("dense_id % 2 = 0")).select("dense_id", "source_id", F.md5("sequence").alias("seq_md5"))


@query("csr_import", f"WITH {HOPS}, ids AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS dense_id FROM supplier) SELECT row_number() OVER (ORDER BY a.dense_id, b.dense_id) - 1 AS slot, a.dense_id AS src, b.dense_id AS dst, source * 1000 + target AS weight FROM g_edges JOIN ids a ON a.k = source JOIN ids b ON b.k = target")
def csr_import(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose targets stand in falling order, put in order with their weights."""
    ids = tensor.dense_ids(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id")), "node_id")
    e = supplier_edges(spark, d).join(ids.select(F.col("node_id").alias("source"), F.col("dense_id").alias("src")), "source").join(ids.select(F.col("node_id").alias("target"), F.col("dense_id").alias("dst")), "target")
    down = ranked(e.select("src", "dst", (-F.col("dst")).alias("down"), (F.col("source") * 1000 + F.col("target")).alias("weight")), ["src", "down"], "place").withColumn("place", F.col("place") - 1)
    ends = pointers(down.select("src"), ids, "src")
    last = ends.agg((F.max("dense_id") + 1).alias("dense_id"), F.lit(down.count()).cast("long").alias("indptr"))
    return tensor.from_rows(ends.unionByName(last), down.select("place", "dst", "weight"))


@query("geometric_states", "SELECT o_custkey::VARCHAR AS unitig_id, round(avg(o_orderkey % 180), 6) AS lon, round(avg(o_orderkey % 90), 6) AS lat, round(avg(o_totalprice), 4) AS coverage FROM orders GROUP BY 1")
def geometric_states(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    mapping = o.select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").cast("string").alias("unitig_id"))
    places = o.select(F.col("o_orderkey").alias("node_id"), (F.col("o_orderkey") % 180).cast("double").alias("lon"), (F.col("o_orderkey") % 90).cast("double").alias("lat"), F.col("o_totalprice").alias("coverage"))
    out = tensor.geometric_states(Compacted(mapping, mapping, mapping, mapping), places)
    return out.select("unitig_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("coverage", 4).alias("coverage"))


@query("edge_targets", f"WITH {HOPS} SELECT source || '>' || target AS link_id, concat_ws('', " + ", ".join(f"CASE WHEN source % 5 = {c} OR target % 5 = {c} THEN 1 ELSE 0 END" for c in (3, 4, 0, 1)) + ") AS targets FROM g_edges")
def edge_target_rows(spark: SparkSession, d: str) -> DataFrame:
    links = supplier_edges(spark, d).select(F.concat_ws(">", "source", "target").alias("link_id"), F.array((F.col("source") % 5).cast("int"), (F.col("target") % 5).cast("int")).alias("color_ids"))
    names = spark.range(5).select(F.col("id").cast("int").alias("color_id"), F.expr("case when id >= 3 then 'high' when id < 2 then 'low' else 'other' end").alias("namespace"), F.col("id").cast("string").alias("value"))
    return tensor.edge_targets(links, names, ["high", "low"])[0].select("link_id", F.concat_ws("", F.col("targets").cast("array<string>")).alias("targets"))


# Colours --------------------------------------------------------------------

COVERED = f"""{UNITIGS}, n AS (SELECT unitig_id AS node_id, string_agg(CASE WHEN ordinal = 0 THEN kmer ELSE right(kmer, 1) END, '' ORDER BY ordinal) AS s FROM mapping JOIN nodes USING (node_id) GROUP BY unitig_id),
hits AS (SELECT node_id, read_id, sample_id FROM n JOIN reads ON CASE WHEN length(seq) < length(s) THEN seq <> '' AND (contains(s, seq) OR contains(s, {rc_sql('seq')})) ELSE contains(seq, s) OR contains({rc_sql('seq')}, s) END)"""


@query("colour_any_nodes", f"WITH RECURSIVE {graph_sql(K)}, {COVERED} SELECT node_id, sample_id, count(*) AS depth FROM hits GROUP BY 1, 2")
def colour_any_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Unitigs of the read graph as nodes of many lengths, coloured by whole reads."""
    n = compact(read_graph(spark, d, K)).unitigs.select(F.col("unitig_id").alias("node_id"), "sequence")
    return colour.colour_any_nodes_by_reads(cut(n, "nodes"), cut(reads(spark, d), "reads"))


@query("colour_accession", f"WITH RECURSIVE {graph_sql(K)}, {COVERED} SELECT node_id, 'A_' || split_part(read_id, '_', 2) AS accession, count(*) AS depth FROM hits GROUP BY 1, 2")
def colour_accession(spark: SparkSession, d: str) -> DataFrame:
    n = compact(read_graph(spark, d, K)).unitigs.select(F.col("unitig_id").alias("node_id"), "sequence")
    r = reads(spark, d).select(F.concat(F.lit("A_"), F.substring_index("read_id", "_", -1), F.lit("_"), "read_id").alias("read_id"), "seq")
    none = spark.createDataFrame([], "edge_id string, source string, target string, orientation string")
    return colour.colour_by_accession(cut(n, "nodes"), none, cut(r, "reads"), K)[0].select("node_id", F.col("sample_id").alias("accession"), "depth")


@query("composition_edges", f"WITH {HOPS}, v AS (SELECT s_suppkey, 'cluster_' || (s_nationkey % 3) AS value FROM supplier) SELECT source || '>' || target AS edge_id, a.value FROM g_edges JOIN v a ON a.s_suppkey = source JOIN v b ON b.s_suppkey = target WHERE a.value = b.value")
def composition_edges(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.concat(F.lit("cluster_"), (F.col("s_nationkey") % 3).cast("string")).alias("value"))
    return colour.shared_values(supplier_edges(spark, d).withColumn("edge_id", F.concat_ws(">", "source", "target")), v)


@query("composition_colours")
def composition_colours(spark: SparkSession, d: str) -> DataFrame:
    """Reads clustered by their 4-mers; Lloyd's rounds are no SQL."""
    n = reads(spark, d).where("seq <> ''").select(F.col("read_id").alias("node_id"), F.col("seq").alias("sequence"))
    none = spark.createDataFrame([], "edge_id string, source string, target string")
    return colour.colour_by_composition(n, none)[0]


@query("paint_namespace", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (p_size % 3) || ',' || (3 + dense_rank() OVER (ORDER BY f) - 1) ELSE (p_size % 3)::VARCHAR END AS colors FROM (SELECT *, min(CASE WHEN p_partkey % 2 = 0 THEN p_partkey END) OVER (PARTITION BY p_brand) AS f FROM part)")
def paint_namespace(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    own = p.select(F.col("p_partkey").alias("id"), F.array((F.col("p_size") % 3).cast("int")).alias("color_ids"))
    values = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("pos"))
    names = spark.range(3).select(F.col("id").cast("int").alias("color_id"), F.lit("size").alias("namespace"), F.col("id").cast("string").alias("value"))
    return colour.paint(own, values, names, "brand")[0].select(F.col("id").alias("p_partkey"), F.array_join("color_ids", ",").alias("colors"))


# Annotations and edits ------------------------------------------------------


@query("annot_transfer", "SELECT s_suppkey AS id, 's_name' AS feature, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', s_nationkey::VARCHAR FROM supplier")
def annot_transfer(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return annotate.transfer(s, "s_suppkey", ["s_name", "s_nationkey"], s.select(F.col("s_suppkey").alias("id")))


@query("edit_reassign", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_mktsegment END AS value FROM customer")
def edit_reassign(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    return annotate.reassigned(c, c.where("id % 4 = 0").select("id", F.lit("X").alias("value")))


@query("edit_suspicious", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS value FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def edit_suspicious(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return annotate.marked(c.where("id % 2 = 0").withColumn("value", F.lit(0)), c.where("id % 3 = 0"), c)


@query("fresh_names", "SELECT 'n' || c_custkey AS id, 'n' || c_custkey || CASE WHEN c_custkey % 6 = 0 THEN '_4' WHEN c_custkey % 3 = 0 THEN '_2' ELSE '' END AS fresh FROM customer")
def fresh_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("n"), F.col("c_custkey").cast("string"))
    c = table(spark, d, "customer")
    taken = c.where("c_custkey % 3 = 0").select(name.alias("id"))
    more = c.where("c_custkey % 6 = 0").select(F.explode(F.array(F.concat(name, F.lit("_2")), F.concat(name, F.lit("_3")), F.concat(name, F.lit("_5")))).alias("id"))
    return edits.fresh_names(c.select(name.alias("id")), taken.unionByName(more))


@query("edit_add_edges", f"WITH {HOPS} SELECT source || '>' || target AS link_id, source::VARCHAR AS source, target::VARCHAR AS target FROM g_edges UNION ALL SELECT 'l_p_a' || s_suppkey, s_suppkey::VARCHAR, (s_suppkey - 1)::VARCHAR FROM supplier WHERE s_suppkey % 5 = 1")
def edit_add_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    new = table(spark, d, "supplier").where("s_suppkey % 5 = 1").select(F.concat(F.lit("a"), k.cast("string")).alias("edit_id"), F.lit("add_edge").alias("kind"), k.cast("string").alias("unitig_id"), (k - 1).cast("string").alias("other"), F.lit(None).cast("string").alias("link_id"), F.lit(None).cast("int").alias("cut_after"), F.lit("+-").alias("orientation"), F.lit(None).cast("int").alias("overlap"))
    return apply_proposal(_as_links(spark, d), new, "p", "suppliers").graph.links.select("link_id", "source", "target")


@query("edit_lineage", f"WITH RECURSIVE {graph_sql(K)}, {UNITIGS}, u AS (SELECT unitig_id, count(*) AS n FROM mapping GROUP BY 1) SELECT 1::BIGINT AS rule, 'u_p_' || unitig_id || x AS at FROM u, (VALUES ('_a'), ('_b')) v(x) WHERE n >= 3")
def edit_lineage(spark: SparkSession, d: str) -> DataFrame:
    """New unitigs held against an old graph from which their parents are gone."""
    c = compact(read_graph(spark, d, K))
    batch = c.sizes.where("n >= 3").selectExpr("unitig_id as edit_id", "'split' as kind", "unitig_id", "cast(null as string) as other", "cast(null as string) as link_id", "0 as cut_after", "cast(null as string) as orientation", "cast(null as int) as overlap")
    after = apply_proposal(c, batch, "p", "reads")
    before = Compacted(c.mapping, c.unitigs.where("size(members) < 3"), c.links, c.internal, c.k)
    return application_violations(before, after).select(F.col("rule").cast("long").alias("rule"), "at")


EDIT_ROW = ["edit_id", "kind", "unitig_id", "other", "link_id", "cut_after", "orientation", "overlap", "nth", "target", "target_type", "namespace", "feature", "dtype", "value"]


def _edits(rows: DataFrame, **given: str) -> DataFrame:
    """Edits with the given expressions and nulls for all else."""
    types = {"cut_after": "int", "overlap": "int", "nth": "int"}
    return rows.selectExpr(*[f"cast({given.get(c, 'null')} as {types.get(c, 'string')}) as {c}" for c in EDIT_ROW])


@query(
    "edit_versions",
    f"""WITH RECURSIVE {graph_sql(K)}, {UNITIGS}, u AS (SELECT unitig_id, count(*) AS n FROM mapping GROUP BY 1)
SELECT 'size' AS namespace, 'node' AS target_type, unitig_id AS target_id, CASE WHEN n = 1 THEN 1 WHEN substr(unitig_id, 2)::INT % 2 = 0 THEN 300 ELSE 202 END::BIGINT AS value FROM u WHERE n < 3
UNION ALL SELECT 'qc', 'node', unitig_id, 1 FROM u WHERE n = 1
UNION ALL SELECT 'support', CASE WHEN ordinal = 1 AND n > 3 THEN 'edge' ELSE 'internal_edge' END, edge_id, substr(edge_id, 2)::BIGINT FROM absorbed JOIN mapping ON node_id = target JOIN u USING (unitig_id)""",
)
def edit_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two batches over the read graph's unitigs: splits with changes and marks of others, then merges of the halves and further changes; values of split edges move with them."""
    c = compact(read_graph(spark, d, K))
    u = sized(cut(c.sizes, "sizes"))
    source = dict.fromkeys(PROVENANCE, "x")
    small = u.where("n < 3").select(F.col("unitig_id").alias("target_id"), F.col("n").alias("value"))
    layers = attach(Layers.none(spark), small, u.select(F.col("unitig_id").alias("target_id")), ("size", "members", "node"), "int64", source)
    inner = c.internal.select(F.col("edge_id").alias("target_id"), F.expr("cast(substring(edge_id, 2) as long)").alias("value"))
    layers = attach(layers, inner, inner.select("target_id"), ("support", "place", "internal_edge"), "int64", source)
    change = {"kind": "'change_annotation'", "target": "unitig_id", "namespace": "'size'", "feature": "'members'", "dtype": "'int64'"}
    two = u.where("n = 2")
    first = _edits(u.where("n >= 3"), edit_id="unitig_id", kind="'split'", unitig_id="unitig_id", cut_after="0", nth="0")
    for nth, value in ((2, 202), (1, 102)):
        first = first.unionByName(_edits(two, edit_id=f"concat('c{nth}', unitig_id)", nth=str(nth), value=str(value), **change))
    first = first.unionByName(_edits(u.where("n = 1"), edit_id="concat('m', unitig_id)", kind="'mark_suspicious'", target="unitig_id", nth="3"))
    halves = [f"concat('u_p_', unitig_id, '_{side}')" for side in "ab"]
    second = _edits(u.where("n = 3"), edit_id="concat('j', unitig_id)", kind="'merge'", unitig_id=halves[0], other=halves[1], nth="0")
    second = second.unionByName(_edits(two.where("cast(substring(unitig_id, 2) as int) % 2 = 0"), edit_id="concat('c', unitig_id)", nth="1", value="300", **change))
    made = apply_batch(apply_batch(Version.first(spark, c, layers, "reads"), first, "p"), second, "q")
    return made.layers.values.select("namespace", "target_type", "target_id", F.col("whole")[0].alias("value"))


# Directed graphs of tables ---------------------------------------------------

DIGRAPH = f"""{HOPS}, e AS (SELECT 'e' || lpad(row_number() OVER (ORDER BY source, target)::VARCHAR, 6, '0') AS edge_id, source, target, source * 1000000 + target AS pos FROM g_edges),
seen AS (SELECT 0 AS phase, s_suppkey AS pos, s_suppkey::VARCHAR AS id, 0 AS c, 'nation' AS namespace, s_nationkey::VARCHAR AS value FROM supplier
UNION ALL SELECT 0, s_suppkey, s_suppkey::VARCHAR, 1, 'band', 'b ' || s_suppkey % 4 FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 1, pos, edge_id, 0, 'nation', ((source + target) % 40)::VARCHAR FROM e UNION ALL SELECT 1, pos, edge_id, 1, 'band', 'b ' || target % 6 FROM e WHERE target % 3 <> 0),
dict AS (SELECT row_number() OVER (ORDER BY c, seen_at, value) - 1 AS color_id, namespace, value FROM (SELECT c, namespace, value, min((phase, pos)) AS seen_at FROM seen GROUP BY 1, 2, 3)),
sets AS (SELECT phase, id, string_agg(color_id, ',' ORDER BY color_id) AS colors FROM seen JOIN dict USING (namespace, value) GROUP BY 1, 2)"""


def _digraph(spark: SparkSession, d: str) -> tensor.Digraph:
    """Suppliers that follow each other in orders, coloured by two columns of both tables."""
    k = F.col("s_suppkey")
    band = F.when(k % 5 != 0, F.concat(F.lit(" b\t"), (k % 4).cast("string"))).otherwise("  ")
    nodes = table(spark, d, "supplier").select(k.cast("string").alias("node_id"), k.alias("pos"), F.col("s_nationkey").cast("string").alias("nation"), band.alias("band"), F.col("s_acctbal").cast("string").alias("balance"), F.col("s_name").alias("name"), F.lit("").alias("unused"))
    s, t = F.col("source"), F.col("target")
    edges = supplier_edges(spark, d).select(s.cast("string").alias("source"), t.cast("string").alias("target"), (s * 1000000 + t).alias("pos"), ((s + t) % 40).cast("string").alias("nation"), F.when(t % 3 != 0, F.concat(F.lit("b "), (t % 6).cast("string"))).alias("band"))
    return tensor.coloured_digraph(nodes, edges, 21, ["nation", "band"], ["balance", "name", "unused"])


@query("digraph_nodes", f"WITH {DIGRAPH} SELECT s_suppkey::VARCHAR AS node_id, s_nationkey::VARCHAR AS nation, CASE WHEN s_suppkey % 5 <> 0 THEN 'b ' || s_suppkey % 4 ELSE '' END AS band, round(s_acctbal, 2) AS balance, s_name AS name, colors, 40 AS length FROM supplier LEFT JOIN sets ON phase = 0 AND id = s_suppkey::VARCHAR")
def digraph_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = _digraph(spark, d).graph.nodes
    return n.select("node_id", "nation", "band", F.round("balance", 2).alias("balance"), "name", F.array_join("color_ids", ",").alias("colors"), F.length("sequence").alias("length"))


@query("digraph_edges", f"WITH {DIGRAPH} SELECT edge_id, source::VARCHAR AS source, target::VARCHAR AS target, ((source + target) % 40)::VARCHAR AS nation, CASE WHEN target % 3 <> 0 THEN 'b ' || target % 6 ELSE '' END AS band, colors FROM e LEFT JOIN sets ON phase = 1 AND id = edge_id")
def digraph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _digraph(spark, d).graph.edges.select("edge_id", "source", "target", "nation", "band", F.array_join("color_ids", ",").alias("colors"))


@query("digraph_dictionary", f"WITH {DIGRAPH} SELECT color_id, namespace, value FROM dict")
def digraph_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _digraph(spark, d).dictionary.select(F.col("color_id").cast("long").alias("color_id"), "namespace", "value")


@query(
    "nearest_ratio",
    """WITH p AS (SELECT row_number() OVER () AS r, x, y FROM (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings UNION ALL SELECT embedding[1]::DOUBLE, embedding[2]::DOUBLE FROM embeddings WHERE label = 3)),
d AS (SELECT a.r, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM p a JOIN p b ON a.r <> b.r GROUP BY 1)
SELECT count(*) AS n, round(median(d), 9) AS median, round(median(d) / (1.5 * sqrt(1.0 / count(*))), 9) AS ratio FROM d""",
)
def nearest_ratio(spark: SparkSession, d: str) -> DataFrame:
    """First two components of the vectors as places; those of one label stand twice."""
    v = table(spark, d, "embeddings")
    place = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xy")]
    both = v.select(*place).unionByName(v.where("label = 3").select(*place))
    return nearest_neighbour_ratio(both, 1.5).select("n", F.round("median", 9).alias("median"), F.round("ratio", 9).alias("ratio"))


@query(
    "edge_index",
    f"""WITH RECURSIVE {graph_sql(K)}, {UNITIGS}, u AS (SELECT unitig_id, count(*) AS n FROM mapping GROUP BY 1),
at_ AS (SELECT node_id, CASE WHEN n < 3 THEN unitig_id WHEN n = 3 THEN 'u_q_j' || unitig_id || '_m' WHEN ordinal = 0 THEN 'u_p_' || unitig_id || '_a' ELSE 'u_p_' || unitig_id || '_b' END AS uid, CASE WHEN n > 3 AND ordinal > 0 THEN ordinal - 1 ELSE ordinal END AS place FROM mapping JOIN u USING (unitig_id)),
dense AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS dense_id FROM (SELECT DISTINCT uid FROM at_)),
ends AS (SELECT e.edge_id, a.dense_id AS src, b.dense_id AS dst, y.place, x.uid = y.uid AND ab.edge_id IS NOT NULL AS inner_ FROM edges e JOIN at_ x ON x.node_id = e.source JOIN at_ y ON y.node_id = e.target JOIN dense a ON a.uid = x.uid JOIN dense b ON b.uid = y.uid LEFT JOIN absorbed ab ON ab.edge_id = e.edge_id)
SELECT 'node' AS kind, dst AS at, place::INTEGER AS place, edge_id FROM ends WHERE inner_ UNION ALL SELECT 'slot', row_number() OVER (ORDER BY src, dst, edge_id) - 1, 0, edge_id FROM ends WHERE NOT inner_""",
)
def edge_index(spark: SparkSession, d: str) -> DataFrame:
    """Edges behind a layout of the read graph after its longer unitigs were split and those of three members merged again."""
    c = compact(read_graph(spark, d, K))
    u = sized(cut(c.sizes, "sizes"))
    columns = EDIT_ROW[:8]
    splits = _edits(u.where("n >= 3"), edit_id="unitig_id", kind="'split'", unitig_id="unitig_id", cut_after="0").select(*columns)
    first = apply_proposal(c, splits, "p", "reads").graph
    halves = [f"concat('u_p_', unitig_id, '_{side}')" for side in "ab"]
    merges = _edits(u.where("n = 3"), edit_id="concat('j', unitig_id)", kind="'merge'", unitig_id=halves[0], other=halves[1]).select(*columns)
    made = apply_proposal(first, merges, "q", "reads__p").graph
    built = tensor.layout(made)
    return identity.edge_index(built.rows, built.slots, made.mapping, made.internal, made.unitigs)


@query(
    "graph_digest",
    f"""WITH {HOPS}, lines AS (SELECT '00 graph' AS section, lpad(i::VARCHAR, 20, '0') AS nth, v AS line FROM (VALUES (0, 'graph_id=suppliers'), (1, 'graph_type=transit'), (2, 'k=None')) t(i, v)
UNION ALL SELECT '10 edges', x, x FROM (SELECT 'edges' || chr(9) || source || chr(9) || target || chr(9) || (source % 5) || ',' || (target % 3) AS x FROM g_edges) UNION ALL SELECT '10 nodes', x, x FROM (SELECT 'nodes' || chr(9) || s_suppkey || chr(9) || s_name AS x FROM supplier)
UNION ALL SELECT '20 palette', lpad(r_regionkey::VARCHAR, 20, '0'), 'palette' || chr(9) || r_regionkey || chr(9) || 'region' || chr(9) || r_name FROM region),
r AS (SELECT line, row_number() OVER (ORDER BY section, nth) - 1 AS i FROM lines), a AS (SELECT i // 4096 AS g, sha256(string_agg(line, chr(10) ORDER BY i)) AS h FROM r GROUP BY 1)
SELECT CASE WHEN count(*) > 1 THEN sha256(string_agg(h, chr(10) ORDER BY g)) ELSE any_value(h) END AS digest, (SELECT count(*) FROM r) AS n FROM a""",
)
def graph_digest(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "supplier").select("s_suppkey", "s_name")
    edges = supplier_edges(spark, d).withColumn("color_ids", F.array(F.col("source") % 5, F.col("target") % 3))
    palette = table(spark, d, "region").select(F.col("r_regionkey").alias("color_id"), F.lit("region").alias("namespace"), F.col("r_name").alias("value"))
    return identity.graph_digest({"graph_id": "suppliers", "graph_type": "transit", "k": None}, {"nodes": nodes, "edges": edges}, palette)


# Learning -------------------------------------------------------------------


@query("covering_rows", """WITH l AS (SELECT p_partkey AS id, unnest([p_size % 7, p_partkey % 5]) AS label FROM part WHERE p_partkey % 4 <> 0), f AS (SELECT label, min(id) AS id FROM l GROUP BY 1), need AS (SELECT DISTINCT id FROM f UNION SELECT p_partkey FROM part WHERE p_partkey % 4 = 0 AND p_partkey < (SELECT min(id) FROM f)),
r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS r FROM part WHERE p_partkey NOT IN (SELECT id FROM need))
SELECT id FROM need UNION ALL SELECT id FROM r WHERE r <= greatest((SELECT count(*) FROM need), (SELECT round(0.8 * count(*)) FROM part)) - (SELECT count(*) FROM need)""")
def covering_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    labels = F.when(k % 4 != 0, F.array_distinct(F.array((F.col("p_size") % 7).cast("long"), k % 5))).otherwise(F.array().cast("array<long>"))
    return ml.covering_rows(table(spark, d, "part").select(k.alias("id"), k.alias("order"), labels.alias("labels")), 0.8)


COVERING = f"""d AS (SELECT p_partkey AS id, p_size, drawn FROM {ml.permuted_sql('p_partkey', 11).format(source='part')}), l AS (SELECT id, drawn, unnest([p_size % 7, id % 5]) AS label FROM d WHERE id % 4 <> 0), f AS (SELECT label, min(drawn) AS drawn FROM l GROUP BY 1),
need AS (SELECT DISTINCT drawn FROM f UNION SELECT drawn FROM d WHERE id % 4 = 0 AND drawn < (SELECT min(drawn) FROM f)), r AS (SELECT id, row_number() OVER (ORDER BY drawn) AS r FROM d WHERE drawn NOT IN (SELECT drawn FROM need))"""


@query("covering_drawn", f"WITH {COVERING} SELECT id, drawn IN (SELECT drawn FROM need) OR coalesce(r <= greatest((SELECT count(*) FROM need), (SELECT round(0.8 * count(*)) FROM part)) - (SELECT count(*) FROM need), FALSE) AS trained FROM d LEFT JOIN r USING (id)")
def covering_drawn(spark: SparkSession, d: str) -> DataFrame:
    """The rows of covering_rows drawn in a seed's order."""
    k = F.col("p_partkey")
    labels = F.when(k % 4 != 0, F.array_distinct(F.array((F.col("p_size") % 7).cast("long"), k % 5))).otherwise(F.array().cast("array<long>"))
    return ml.covering_split(table(spark, d, "part").select(k.alias("id"), k.alias("number"), labels.alias("labels")), 0.8, 11)


@query("class_weights", "SELECT label, round((SELECT count(*) FROM embeddings) / (10.0 * count(*)), 9) AS weight FROM embeddings GROUP BY 1")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return ml.class_weights(table(spark, d, "embeddings").select("label"), 10).select("label", F.round("weight", 9).alias("weight"))


SPLIT = "r AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN label ELSE (label + vec_id) % 10 END AS p, vec_id % 5 <> 0 AS trained FROM embeddings)"


@query("accuracies", f"WITH {SPLIT}, c AS (SELECT label FROM r WHERE trained GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) SELECT round(avg((label = p)::INT) FILTER (trained), 9) AS train, round(avg((label = p)::INT) FILTER (NOT trained), 9) AS heldout, round(avg((label = (SELECT label FROM c))::INT) FILTER (NOT trained), 9) AS majority FROM r")
def accuracies(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    rows = v.select("label", F.when(F.col("vec_id") % 3 == 0, F.col("label")).otherwise((F.col("label") + F.col("vec_id")) % 10).alias("predicted"), (F.col("vec_id") % 5 != 0).alias("trained"))
    return ml.accuracies(rows).select(*[F.round(c, 9).alias(c) for c in ("train", "heldout", "majority")])


@query("micro_f1", """WITH b AS (SELECT vec_id % 5 <> 0 AS trained, unnest([(vec_id % 2)::INT, (vec_id % 3 = 0)::INT, (label = 4)::INT]) AS t, unnest([(label % 2)::INT, (vec_id % 6 = 0)::INT, (label > 3)::INT]) AS g FROM embeddings),
c AS (SELECT trained, count(*) FILTER (t = 1 AND g = 1) AS h, count(*) FILTER (t = 0 AND g = 1) AS x, count(*) FILTER (t = 1 AND g = 0) AS l FROM b GROUP BY 1)
SELECT round(max(2.0 * h / (2 * h + x + l)) FILTER (trained), 9) AS train, round(max(2.0 * h / (2 * h + x + l)) FILTER (NOT trained), 9) AS heldout FROM c""")
def micro_f1(spark: SparkSession, d: str) -> DataFrame:
    return ml.micro_f1(_flags(spark, d)).select(F.round("train", 9).alias("train"), F.round("heldout", 9).alias("heldout"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    i, label = F.col("vec_id"), F.col("label")
    t = F.array((i % 2).cast("int"), (i % 3 == 0).cast("int"), (label == 4).cast("int"))
    g = F.array((label % 2).cast("int"), (i % 6 == 0).cast("int"), (label > 3).cast("int"))
    return table(spark, d, "embeddings").select(i.alias("id"), t.alias("targets"), g.alias("guesses"), (i % 5 != 0).alias("trained"))


@query("flagged_labels", "SELECT vec_id AS id, name, t AS target, g AS predicted FROM (SELECT vec_id, unnest(['a', 'b', 'c']) AS name, unnest([(vec_id % 2)::INT, (vec_id % 3 = 0)::INT, (label = 4)::INT]) AS t, unnest([(label % 2)::INT, (vec_id % 6 = 0)::INT, (label > 3)::INT]) AS g FROM embeddings) WHERE t = 1 OR g = 1")
def flagged_labels(spark: SparkSession, d: str) -> DataFrame:
    return ml.flagged(_flags(spark, d), ["a", "b", "c"])


@query("prediction_table", "SELECT vec_id AS target_id, label AS predicted_class, round((vec_id % 100) / 100.0, 6) AS probability, 'm' AS model_id FROM embeddings")
def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("target_id"), F.col("label").alias("predicted_class"), F.round((F.col("vec_id") % 100) / 100.0, 6).alias("probability"))
    return ml.predictions(v, "m", "1", 10).select("target_id", "predicted_class", "probability", "model_id")


# Transit and overlap graphs -------------------------------------------------

TRIPS = """t AS (SELECT l_orderkey AS trip, 'r' || (o_custkey % 6) AS route, l_suppkey AS stop, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
served AS (SELECT DISTINCT stop, route FROM t), flow AS (SELECT route, count(*) AS f FROM served GROUP BY 1), cov AS (SELECT stop, sum(f)::DOUBLE AS c FROM served JOIN flow USING (route) GROUP BY 1),
named AS (SELECT route, substr(route, 2)::INT % 2 AS m, 2 + row_number() OVER (ORDER BY CASE WHEN substr(route, 2)::INT % 2 = 0 THEN 'bus' ELSE 'tram' END, 'L' || (substr(route, 2)::INT // 4), route) - 1 AS c FROM flow)"""


def _transit(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("name"))
    i = F.col("id")
    routes = spark.range(6).select(F.concat(F.lit("r"), i.cast("string")).alias("route_id"), F.when(i % 2 == 0, "bus").otherwise("tram").alias("mode"), F.concat(F.lit("L"), F.expr("id div 4").cast("string")).alias("short_name"))
    order = "l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_shipdate"
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("r"), (F.col("o_custkey") % 6).cast("string")).alias("route_id"))
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey", f"row_number() over (partition by l_orderkey order by {order}) as pos", "l_suppkey as stop_id")
    visits = lines.join(shuffled(o), "l_orderkey").withColumnRenamed("l_orderkey", "trip_id")
    flows = lambda served: served.groupBy("route_id").agg(F.count("*").cast("double").alias("flow"))
    return transit.transit_graph(s, routes, visits, ["bus", "tram"], 21, flows)


@query("transit_nodes", f"WITH {TRIPS} SELECT 's' || stop AS node_id, s_name AS stop_name, c AS coverage, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT m AS x FROM served v JOIN named USING (route) WHERE v.stop = cov.stop UNION SELECT named.c FROM served v JOIN named USING (route) WHERE v.stop = cov.stop)) AS colors FROM cov JOIN supplier ON s_suppkey = stop")
def transit_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _transit(spark, d)[0].select("node_id", "stop_name", "coverage", F.array_join("color_ids", ",").alias("colors"))


@query("transit_hops", f"""WITH {TRIPS}, h AS (SELECT DISTINCT route, stop AS a, nxt AS b FROM (SELECT *, lead(stop) OVER (PARTITION BY trip ORDER BY pos) AS nxt FROM t) WHERE nxt IS NOT NULL AND nxt <> stop),
e AS (SELECT a, b, row_number() OVER (ORDER BY 's' || a, 's' || b) AS r FROM (SELECT DISTINCT a, b FROM h))
SELECT printf('e%06d', r) AS edge_id, 's' || e.a AS source, 's' || e.b AS target, (x.c + y.c) / 2 AS coverage FROM e JOIN cov x ON x.stop = e.a JOIN cov y ON y.stop = e.b""")
def transit_hops(spark: SparkSession, d: str) -> DataFrame:
    return _transit(spark, d)[1].select("edge_id", "source", "target", "coverage")


@query("overlap_graph", f"""WITH {READS}, c AS (SELECT seq, row_number() OVER (ORDER BY read_id) AS i FROM reads WHERE length(seq) >= 9), p AS (SELECT a.i AS a, b.i AS b FROM c a JOIN c b ON right(a.seq, 8) = left(b.seq, 8) AND a.i <> b.i)
SELECT printf('e%06d', row_number() OVER (ORDER BY a, b)) AS edge_id, printf('n%06d', a) AS source, printf('n%06d', b) AS target FROM p""")
def overlap_graph(spark: SparkSession, d: str) -> DataFrame:
    contigs = reads(spark, d).where("length(seq) >= 9").select(F.col("read_id").alias("id"), "seq", F.col("read_id").alias("pos"))
    return build.overlap_graph(contigs, 9).edges.select("edge_id", "source", "target")


@query("doc_kmers", f"WITH {DOC_SEQS}, k AS (SELECT substr(seq, i, 11) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 9)) AS i FROM seqs WHERE length(seq) >= 11)) SELECT kmer, count(*) AS n FROM k GROUP BY 1")
def doc_kmers(spark: SparkSession, d: str) -> DataFrame:
    """11-letter windows of whole documents, counted."""
    return sample_counts(doc_seqs(spark, d).withColumn("sample_id", F.lit("all")), 11, by_read=False, strands=False).select("kmer", "n")
