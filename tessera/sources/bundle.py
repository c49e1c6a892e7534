"""Folders of text tables that hold a graph, its compacted form or its annotation layers.

A folder has ``metadata.json`` and one subfolder for each table; tables are
headed tab-separated part files and sequences FASTA part files, so they are
written and read by many tasks. Nested cells are those of
:mod:`tessera.functions.cells`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.errors import ContractError, require_none
from tessera.functions import cells
from tessera.operators.annotate import Layers
from tessera.operators.colour import filter_colours
from tessera.operators.compact import Compacted, inner_edges
from tessera.operators.validate import compacted_violations, require_valid, table_violations
from tessera.sources.text import fasta, require_records, tsv, write_fasta, write_tsv

VERSION = "1.0"
#: Declared feature types and the Spark types of their columns.
TYPES = {"int": "long", "float": "double", "str": "string", "label": "int", "orientation": "string"}


@dataclass(frozen=True)
class Bundle:
    """metadata, nodes (node_id, sequence, ...), edges (edge_id, source, target, ...) and dictionaries of colours and labels."""

    metadata: dict
    nodes: DataFrame
    edges: DataFrame
    colors: DataFrame | None = None
    labels: DataFrame | None = None


@dataclass(frozen=True)
class CompactedBundle:
    """metadata, a compacted graph whose tables carry ``color_ids``, its colours and its layers."""

    metadata: dict
    graph: Compacted
    colors: DataFrame | None = None
    layers: Layers | None = field(default=None)


def _write_metadata(spark: SparkSession, metadata: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/metadata.json")


def _read_metadata(spark: SparkSession, path: str) -> dict:
    value = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/metadata.json").collect()))
    if not isinstance(value, dict):
        raise ContractError(["metadata is no mapping"])
    return value


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _cell(name: str, dtype: str) -> Column:
    return cells.joined(F.col(name)).alias(name) if dtype.startswith("array") else F.col(name)


def _table(rows: DataFrame, *leave: str) -> DataFrame:
    """Text cells of the columns but those to ``leave``; colour sets are called color_set."""
    out = rows.select(*[_cell(c, t) for c, t in rows.dtypes if c not in leave])
    return out.withColumnRenamed("color_ids", "color_set")


def _typed(rows: DataFrame, features: dict[str, str]) -> DataFrame:
    """Cells cast to their declared types; blank cells of numbers and orientations are null."""
    out = []
    for c in rows.columns:
        kind = "color_set" if c == "color_set" else features.get(c, "str")
        if kind == "color_set":
            out.append(cells.numbers(F.col(c)).alias("color_ids"))
        else:
            out.append((F.when(F.trim(c) != "", F.col(c)).cast(TYPES[kind]) if kind != "str" else F.col(c)).alias(c))
    return rows.select(*out)


def dump_graph(b: Bundle, path: str) -> None:
    """Writes a graph; whatever its rules forbid is an error, and nothing is written."""
    spark = b.nodes.sparkSession
    nodes, edges = _table(b.nodes, "sequence"), _table(b.edges)
    sequences = b.nodes.select(F.col("node_id").alias("id"), F.col("sequence").alias("seq"))
    require_valid(table_violations(b.metadata, nodes, sequences, edges, b.colors, b.labels))
    _write_metadata(spark, b.metadata, path)
    write_fasta(b.nodes, f"{path}/nodes.fna")
    write_tsv(nodes, f"{path}/nodes.tsv")
    write_tsv(edges, f"{path}/edges.tsv")
    for name, rows in (("colors", b.colors), ("labels", b.labels)):
        if rows is not None:
            write_tsv(rows, f"{path}/{name}.tsv")


def load_graph(spark: SparkSession, path: str) -> Bundle:
    """Reads and checks what :func:`dump_graph` writes."""
    lost = [name for name in ("metadata.json", "nodes.fna", "nodes.tsv", "edges.tsv") if not _exists(spark, f"{path}/{name}")]
    if lost:
        raise ContractError([f"{path} has no {name}" for name in lost])
    metadata = _read_metadata(spark, path)
    sequences = require_records(fasta(spark, f"{path}/nodes.fna")).select("id", "seq")
    nodes, edges = tsv(spark, f"{path}/nodes.tsv"), tsv(spark, f"{path}/edges.tsv")
    colors, labels = (tsv(spark, f"{path}/{n}.tsv") if _exists(spark, f"{path}/{n}.tsv") else None for n in ("colors", "labels"))
    require_valid(table_violations(metadata, nodes, sequences, edges, colors, labels))
    features = metadata.get("features") or {}
    typed = _typed(nodes, features.get("node") or {}).join(sequences.select(F.col("id").alias("node_id"), F.col("seq").alias("sequence")), "node_id")
    return Bundle(metadata, typed, _typed(edges, features.get("edge") or {}), colors, labels)


def _coloured(rows: DataFrame) -> DataFrame:
    return rows if "color_ids" in rows.columns else rows.withColumn("color_ids", F.array().cast("array<int>"))


def dump_compacted(b: CompactedBundle, path: str) -> None:
    """Writes a compacted graph with nested cells, and its layers; colours that are missing are empty sets."""
    c, spark = b.graph, b.graph.unitigs.sparkSession
    unitigs = _coloured(c.unitigs)
    if "internal_edge_colors" not in unitigs.columns:
        unitigs = unitigs.withColumn("internal_edge_colors", F.transform("internal_edge_ids", lambda _: F.array().cast("array<int>")))
    # the rules and the files read each table many times
    c = Compacted(cut(_coloured(c.mapping), "mapping"), cut(unitigs, "unitigs"), cut(_coloured(c.links), "links"), c.internal)
    unitigs = c.unitigs
    require_valid(compacted_violations(b.metadata, c, b.colors))
    _write_metadata(spark, b.metadata, path)
    write_fasta(unitigs, f"{path}/unitigs.fna", "unitig_id")
    write_tsv(unitigs.select("unitig_id", cells.joined(F.col("color_ids")).alias("color_set"), cells.joined(F.col("members")).alias("cfa_nodes"), cells.joined(F.col("internal_edge_ids")).alias("internal_edge_ids"), cells.joined_groups(F.col("internal_edge_colors")).alias("internal_edge_colors"), cells.joined(F.col("internal_overlaps")).alias("internal_overlaps")), f"{path}/unitigs.tsv")
    write_tsv(c.links.select("link_id", "source", "target", "orientation", cells.joined(F.col("color_ids")).alias("color_set"), "overlap"), f"{path}/links.tsv")
    write_tsv(c.mapping.select(F.col("node_id").alias("cfa_node_id"), "unitig_id", "ordinal", "length", cells.joined(F.col("color_ids")).alias("color_set")), f"{path}/mapping.tsv")
    if b.colors is not None:
        write_tsv(b.colors, f"{path}/colors.tsv")
    if b.layers is not None:
        dump_layers(b.layers, f"{path}/annotations")


def load_compacted(spark: SparkSession, path: str, namespaces: list[str] | None = None) -> CompactedBundle:
    """Reads and checks what :func:`dump_compacted` writes; with ``namespaces`` only their colours are kept."""
    metadata = _read_metadata(spark, path)
    sequences = fasta(spark, f"{path}/unitigs.fna").select(F.col("id").alias("unitig_id"), F.col("seq").alias("sequence"))
    raw = tsv(spark, f"{path}/unitigs.tsv")
    require_none(raw.where(r"internal_overlaps <> '' and not internal_overlaps rlike '^\\d+(,\\d+)*$'").select("unitig_id"), lambda r: f"the overlaps of {r['unitig_id']} are no numbers")
    unitigs = raw.join(sequences, "unitig_id").select("unitig_id", "sequence", cells.names(F.col("cfa_nodes")).alias("members"), cells.names(F.col("internal_edge_ids")).alias("internal_edge_ids"), cells.numbers(F.col("internal_overlaps")).alias("internal_overlaps"), cells.groups(F.col("internal_edge_colors")).alias("internal_edge_colors"), cells.numbers(F.col("color_set")).alias("color_ids"))
    links = tsv(spark, f"{path}/links.tsv")
    require_none(links.where(r"overlap <> '' and not overlap rlike '^\\d+$'").select("link_id"), lambda r: f"the overlap of link {r['link_id']} is no number")
    links = links.select("link_id", "source", "target", F.when(F.col("orientation") != "", F.col("orientation")).alias("orientation"), F.when(F.col("overlap") != "", F.col("overlap")).cast("int").alias("overlap"), cells.numbers(F.col("color_set")).alias("color_ids"))
    unitigs, links = cut(unitigs, "unitigs"), cut(links, "links")
    mapping = tsv(spark, f"{path}/mapping.tsv").select(F.col("cfa_node_id").alias("node_id"), "unitig_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("length").cast("int").alias("length"), cells.numbers(F.col("color_set")).alias("color_ids"))
    mapping = cut(mapping, "mapping")
    colors = tsv(spark, f"{path}/colors.tsv").withColumn("color_id", F.col("color_id").cast("int")) if _exists(spark, f"{path}/colors.tsv") else None
    c = Compacted(mapping, unitigs, links, inner_edges(unitigs))
    require_valid(compacted_violations(metadata, c, colors))
    if namespaces is not None and colors is not None:
        c, colors = project(c, colors, namespaces)
    layers = load_layers(spark, f"{path}/annotations") if _exists(spark, f"{path}/annotations") else None
    return CompactedBundle(metadata, c, colors, layers)


def project(c: Compacted, colors: DataFrame, namespaces: list[str]) -> tuple[Compacted, DataFrame]:
    """The graph with only the colours of the namespaces; a unitig's are the union of its members', and topology stays."""
    mapping, kept = filter_colours(c.mapping, colors, namespaces)
    links, _ = filter_colours(c.links, colors, namespaces)
    own = mapping.groupBy("unitig_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("color_ids")))).alias("color_ids"))
    groups = c.unitigs.select("unitig_id", F.posexplode("internal_edge_colors").alias("at", "color_ids"))
    groups, _ = filter_colours(groups, colors, namespaces)
    inner = groups.groupBy("unitig_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "color_ids"))), lambda x: x["color_ids"]).alias("internal_edge_colors"))
    unitigs = c.unitigs.drop("color_ids", "internal_edge_colors").join(own, "unitig_id").join(inner, "unitig_id", "left")
    unitigs = unitigs.withColumn("internal_edge_colors", F.coalesce("internal_edge_colors", F.array().cast("array<array<int>>")))
    return Compacted(mapping, unitigs, links, c.internal), kept


def dump_layers(layers: Layers, path: str) -> None:
    """Writes layers as Parquet, one subfolder for each, with a manifest of what there is."""
    spark = layers.values.sparkSession
    layers.values.write.partitionBy("namespace", "feature", "target_type").parquet(f"{path}/values")
    about = [r.asDict(recursive=True) for r in layers.about.collect()]  # one row for each layer
    _write_metadata(spark, {"annotation_sidecar_version": VERSION, "layers": about}, path)


def load_layers(spark: SparkSession, path: str) -> Layers:
    """Reads what :func:`dump_layers` writes; layers without values, or values without a layer, are errors."""
    manifest = _read_metadata(spark, path)
    if str(manifest.get("annotation_sidecar_version")) != VERSION:
        raise ContractError([f"annotation layers of version {manifest.get('annotation_sidecar_version')} are not supported"])
    about = spark.createDataFrame([tuple(r[c] for c in Layers.ABOUT_COLUMNS) for r in manifest["layers"]], Layers.ABOUT)
    values = spark.read.schema(Layers.VALUES).parquet(f"{path}/values").select(*Layers.VALUE_COLUMNS)
    key = ["namespace", "feature", "target_type"]
    have = values.select(*key).distinct()
    require_none(about.select(*key).join(have, key, "left_anti"), lambda r: f"layer {':'.join(r)} has no values")
    require_none(have.join(about.select(*key), key, "left_anti"), lambda r: f"values of {':'.join(r)} belong to no layer")
    return Layers(about, values)
