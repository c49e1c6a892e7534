"""Readers of taxonomies, alignments, timetables and pin tables."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.errors import ContractError, gathered, require_none
from tessera.sources.text import tsv, write_tsv


def taxdump(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """(taxon_id, parent_id, rank, name): the node table with scientific names (fields between '\\t|\\t')."""
    def cells(path: str) -> DataFrame:
        return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.regexp_replace("value", r"\t?\|\s*$", ""), r"\t?\|\t?").alias("c"))

    n = cells(nodes).select(F.col("c")[0].cast("long").alias("taxon_id"), F.col("c")[1].cast("long").alias("parent_id"), F.col("c")[2].alias("rank"))
    s = cells(names).where("c[3] = 'scientific name'").select(F.col("c")[0].cast("long").alias("taxon_id"), F.col("c")[1].alias("name"))
    return n.join(s, "taxon_id", "left")


def paf_best(spark: SparkSession, path: str) -> DataFrame:
    """(query, target, matches): each query's alignment with the most matching bases, the first of equals."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("c"), F.monotonically_increasing_id().alias("line"))
    best = rows.select(F.col("c")[0].alias("query"), F.col("c")[5].alias("target"), F.col("c")[9].cast("long").alias("matches"), "line")
    return best.groupBy("query").agg(F.min_by(F.struct("target", "matches"), F.struct(-F.col("matches"), F.col("line"))).alias("b")).select("query", "b.target", "b.matches")


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    """(taxon_id, n): reads by call in a classifier's output; unclassified reads count as taxon 0."""
    c = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("c"))
    taxon = F.when(F.col("c")[0] == "C", F.coalesce(F.col("c")[2].try_cast("long"), F.lit(0))).otherwise(0)
    return c.groupBy(taxon.cast("long").alias("taxon_id")).agg(F.count("*").alias("n"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(member, size) of a zip archive, read through Spark's own file access."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as archive:
                    found = archive.infolist()
                yield pa.RecordBatch.from_arrays([pa.array([x.filename for x in found], pa.string()), pa.array([x.file_size for x in found], pa.int64())], names=["member", "size"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "member string, size long")


def zip_table(spark: SparkSession, path: str, member: str, columns: Sequence[str]) -> DataFrame:
    """The named columns, as texts, of a headed comma-separated member of a zip archive.

    A member is unpacked by one task as a stream and leaves it in batches; each
    member is read by a task of its own. A member without one of the columns has
    nulls there, and a ragged row is an error.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in names])
        for batch in batches:
            for data in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as archive, archive.open(member) as raw:
                    rows = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                    head = [h.strip() for h in next(rows, [])]
                    at, held = [head.index(n) if n in head else None for n in names], []
                    for row in rows:
                        if not row:
                            continue
                        if len(row) != len(head):
                            raise ValueError(f"a row of {member} has {len(row)} cells, and its header {len(head)}")
                        held.append([None if i is None else row[i].strip() for i in at])
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"`{n}` string" for n in names))


FEED = {"routes": ("route_id", "route_type", "route_short_name"), "trips": ("trip_id", "route_id"), "stop_times": ("trip_id", "stop_sequence", "stop_id"), "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon")}


def timetable(spark: SparkSession, folder: str, modes: dict[int, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stops, routes and visits of a transit feed, unpacked or a zip archive, for routes whose type is in ``modes``.

    stops (stop_id, name, lat, lon), routes (trip_id, route_id, mode, short_name),
    visits (trip_id, stop_sequence, stop_id). A trip of an unknown route is an
    error, and so is an archive without one of the four tables.
    """
    zipped = folder.lower().endswith(".zip")
    if zipped:
        there = {r["member"] for r in zip_members(spark, folder).collect()}  # a feed's few members
        if lost := [f"{folder} has no {name}.txt" for name in FEED if f"{name}.txt" not in there]:
            raise ContractError(lost)

    def table(name: str) -> DataFrame:
        if zipped:
            return cut(zip_table(spark, folder, f"{name}.txt", FEED[name]), name)
        return spark.read.option("header", True).option("encoding", "UTF-8").csv(f"{folder}/{name}.txt")

    mode = F.create_map(*[F.lit(x) for k, v in modes.items() for x in (str(k), v)])
    routes = table("routes").select("route_id", F.col("route_type"), F.col("route_short_name").alias("short_name"))
    trips = table("trips").select("trip_id", "route_id")
    lost = trips.join(routes, "route_id", "left_anti").agg(F.min("route_id")).first()[0]
    if lost is not None:
        raise ContractError([f"trip of an unknown route {lost}"])
    used = trips.join(routes, "route_id").select("trip_id", "route_id", F.try_element_at(mode, F.col("route_type")).alias("mode"), "short_name").where("mode is not null")
    visits = table("stop_times").select("trip_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), "stop_id").join(used.select("trip_id"), "trip_id", "left_semi")
    stops = table("stops").select("stop_id", F.col("stop_name").alias("name"), F.col("stop_lat").cast("double").alias("lat"), F.col("stop_lon").cast("double").alias("lon"))
    return stops.join(visits.select("stop_id").distinct(), "stop_id", "left_semi"), used, visits


def report_identities(spark: SparkSession, path: str) -> DataFrame:
    """(accession, organism): assembly reports in JSON lines, under either spelling of the keys."""
    schema = "accession string, organism struct<organism_name:string, organismName:string>, assembly_accession string, organism_name string"
    rows = spark.read.schema(schema).json(path)
    return rows.select(F.coalesce("accession", "assembly_accession").alias("accession"), F.coalesce("organism.organism_name", "organism.organismName", "organism_name").alias("organism"))


def pin_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a pin table; every pair needs one ``sim`` and one ``db`` row, and sim accessions differ without their versions."""
    rows = tsv(spark, path)
    roles = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list("role")).alias("r")).where("r <> array('db', 'sim')")
    key = F.substring_index("accession", ".", 1)
    twice = rows.where("role = 'sim'").groupBy(key.alias("k")).count().where("count > 1")
    errors = gathered(roles.select("pair_id"), lambda r: f"pair {r['pair_id']} has not one row of sim and one of db")
    errors += gathered(twice.select("k"), lambda r: f"sim accession {r['k']} stands in more than one pair")
    if errors:
        raise ContractError(errors)
    return rows


def bin_scores(spark: SparkSession, path: str, gold: str = "Gold standard") -> DataFrame:
    """The one row of a binning result table that is a tool's and not the gold standard's; more or fewer are an error."""
    rows = tsv(spark, path)
    own = rows.where(F.col("Tool") != gold)
    if (n := own.count()) != 1:
        raise ContractError([f"{path} has {n} rows of tools where one is wanted"])
    return own


def write_bins(contigs: DataFrame, truth: DataFrame, path: str) -> None:
    """(SEQUENCEID, BINID, LENGTH) of every contig (id, length) by ``truth`` (id, bin), in order of ids; a contig without a bin is an error."""
    rows = contigs.join(truth, "id", "left")
    require_none(rows.where("bin is null").select("id"), lambda r: f"contig {r['id']} has no bin")
    write_tsv(rows.orderBy("id").select(F.col("id").alias("SEQUENCEID"), F.col("bin").alias("BINID"), F.col("length").alias("LENGTH")), path)
