"""Readers of sequence and graph files, as text scans and DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.cut import cut
from tessera.errors import ContractError, gathered, require_none
from tessera.functions.seq import header_coverage, oriented, overlaps, reverse_complement
from tessera.operators.ids import numbered, ranked


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, id, header, seq): records of one or more FASTA files; sequences upper-cased, lines joined.

    ``place`` ascends within a file. Files are cut at line starts with '>', so a
    large file is read by many tasks. Text before a file's first header is an error.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), "value")
    first = raw.groupBy("file").agg(F.min_by(F.left(F.ltrim("value"), F.lit(80)), "place").alias("begin"))
    require_none(first.where("begin <> '' and not begin like '>%'"), lambda r: f"{r['file']} has text before its first header: {r['begin']!r}")
    record = F.regexp_replace("value", r"^\s*>", "")  # only a file's first record has its mark left
    rows = raw.where(F.trim(F.regexp_replace("value", r"\s", "")) != "").select("file", "place", record.alias("value"))
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", ""))
    return rows.select("file", "place", F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(head).alias("header"), body.alias("seq"))


def require_records(records: DataFrame) -> DataFrame:
    """The records, or all errors of ids: empty ones and repeats."""
    wrong = records.groupBy("id").count().where("count > 1 or id = ''")
    require_none(wrong, lambda r: f"{r['count']} records are called {r['id']}" if r["id"] else f"{r['count']} records have no id")
    return records


def genomes(spark: SparkSession, folder: str) -> DataFrame:
    """(genome_id, seq) of a folder's .fna, .fa and .fasta files, whatever their case; repeated ids and letters outside ACGTN are errors."""
    rows = fasta(spark, folder).where(F.col("file").rlike(r"(?i)\.(fna|fa|fasta)$"))
    require_none(rows.where("not seq rlike '^[ACGTN]+$'").select("id"), lambda r: f"genome {r['id']} is empty or has letters outside ACGTN")
    return require_records(rows).select(F.col("id").alias("genome_id"), "seq")


def rekeyed(records: DataFrame, key: str) -> DataFrame:
    """(id, seq): records named ``key|0``, ``key|1``, ... in their order."""
    return ranked(records, ["file", "place"], "rank").select(F.concat(F.lit(key + "|"), (F.col("rank") - 1).cast("string")).alias("id"), "seq")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq) of four-line records; blank lines are skipped, qualities dropped.

    Lines are numbered within each split of a file; splits are counted, and only
    those counts meet, so a large file is read by many tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    lines = cut(lines.where(F.trim("value") != "").withColumn("split", F.shiftrightunsigned("at", 33)), "lines")
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = counts.selectExpr("file", "split", "sum(n) over (partition by file order by split) - n as before")
    inside = lines.selectExpr("file", "split", "value", "row_number() over (partition by file, split order by at) - 1 as nth")
    numbered_ = inside.join(before, ["file", "split"]).selectExpr("file", "(before + nth) div 4 as record", "(before + nth) % 4 as part", "value")
    one = [F.max(F.when(F.col("part") == k, F.trim("value"))).alias(name) for k, name in enumerate(("head", "seq", "plus", "quality"))]
    rows = numbered_.groupBy("file", "record").agg(*one)
    wrong = rows.where("quality is null or not head like '@%' or plus <> '+'").select("file", "record")
    require_none(wrong, lambda r: f"record {r['record'] + 1} of {r['file']} is no FASTQ record")
    return rows.select(F.regexp_extract("head", r"^@(\S*)", 1).alias("read_id"), F.upper("seq").alias("seq"))


def gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, sequence) and edges (line, source, target, orientation, overlap) of a GFA 1 file."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c"), F.monotonically_increasing_id().alias("line")).where("c[0] <> ''")
    odd = rows.where("c[0] not in ('S', 'L', 'H', 'P', 'W', 'C') and not c[0] like '#%'").select(F.col("c")[0].alias("k")).first()
    if odd:
        raise ContractError([f"unknown GFA record {odd['k']}"])
    short = rows.where("size(c) < case c[0] when 'S' then 3 when 'L' then 6 else 0 end").select("line", "c")
    require_none(short, lambda r: f"a GFA record has too few cells: {' '.join(r['c'])}")
    nodes = rows.where("c[0] = 'S'").select(F.col("c")[1].alias("node_id"), F.upper(F.col("c")[2]).alias("sequence"))
    links = rows.where("c[0] = 'L'")
    cigar = links.where("not c[5] rlike '^[0-9]+M$'").first()
    if cigar:
        raise ContractError([f"unsupported GFA overlap {cigar['c'][5]}"])
    edges = links.select("line", F.col("c")[1].alias("source"), F.col("c")[3].alias("target"), F.concat(F.col("c")[2], F.col("c")[4]).alias("orientation"), F.regexp_extract(F.col("c")[5], r"^(\d+)", 1).cast("int").alias("overlap"))
    return nodes, edges


def fastg(spark: SparkSession, path: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, sequence, coverage) and edges (source, target, orientation, overlap) of an assembler's FASTG.

    A trailing quote names the reverse strand, which is stored forward; both
    strands give one node (the forward record wins) and edges are distinct.
    """
    r = fasta(spark, path).select(F.regexp_replace("header", ";$", "").alias("h"), "seq")
    r = r.select(F.split("h", ":").alias("p"), "seq").select(F.col("p")[0].alias("name"), F.when(F.size("p") > 1, F.split(F.col("p")[1], ",")).otherwise(F.array().cast("array<string>")).alias("to"), "seq")

    def node(name: str) -> Column:
        return numbered("n", F.regexp_extract(name, r"ID_(\d+)'?$", 1).cast("int"))

    r = r.withColumn("back", F.col("name").endswith("'")).withColumn("node_id", node("name"))
    seqs = r.select("node_id", "back", F.when(F.col("back"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("sequence"), header_coverage(F.col("name")).alias("coverage"))
    nodes = seqs.groupBy("node_id").agg(F.min_by("sequence", "back").alias("sequence"), F.min_by("coverage", "back").alias("coverage"), F.count_distinct("sequence").alias("_n"))
    errors = gathered(nodes.where("_n > 1").select("node_id"), lambda x: f"the two strands of {x['node_id']} are not each other's complement")
    errors += gathered(nodes.where(F.length("sequence") < k + 1).select("node_id"), lambda x: f"{x['node_id']} has fewer than {k + 1} letters")
    edges = r.select("node_id", "back", F.explode("to").alias("t")).where("t <> ''")
    sign = lambda c: F.when(c, "-").otherwise("+")
    edges = edges.select(F.col("node_id").alias("source"), node("t").alias("target"), F.concat(sign(F.col("back")), sign(F.col("t").endswith("'"))).alias("orientation")).distinct()
    errors += gathered(edges.join(nodes, edges.target == nodes.node_id, "left_anti").select("target").distinct(), lambda x: f"an edge leads to {x['target']}, which has no record")
    l, r_ = (nodes.select(F.col("node_id").alias(side), F.col("sequence").alias(name)) for side, name in (("source", "_l"), ("target", "_r")))
    ends = edges.join(l, "source").join(r_, "target")
    fit = overlaps(oriented(F.col("_l"), F.left("orientation", F.lit(1))), oriented(F.col("_r"), F.right("orientation", F.lit(1))), F.lit(k))
    errors += gathered(ends.where(~fit).select("source", "target", "orientation"), lambda x: f"{x['source']} and {x['target']} do not overlap by {k} letters as {x['orientation']}")
    if errors:
        raise ContractError(errors)
    return nodes.drop("_n"), edges.withColumn("overlap", F.lit(k))


def fastg_links(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, sequence) and edges (source, target, orientation), names as they stand; only a target's quote gives an orientation."""
    r = fasta(spark, path).select("file", "place", F.rtrim(F.regexp_replace("header", ";+$", "")).alias("h"), "seq")
    r = r.select("file", "place", F.regexp_extract(F.split("h", ":", 2)[0], r"^\s*(\S*)", 1).alias("node_id"), F.get(F.split("h", ":", 2), F.lit(1)).alias("to"), "seq")
    require_none(r.where("node_id = ''").select("file", "place"), lambda x: f"a record of {x['file']} has no name")
    nodes = r.groupBy("node_id").agg(F.max_by("seq", F.struct("file", "place")).alias("sequence"))
    t = r.select("file", "place", "node_id", F.posexplode(F.split("to", ",")).alias("n", "t")).withColumn("t", F.trim("t"))
    edges = t.select("file", "place", "n", F.col("node_id").alias("source"), F.trim(F.regexp_replace("t", "'$", "")).alias("target"), F.when(F.col("t").endswith("'"), "+-").otherwise("++").alias("orientation")).where("target <> ''")
    return nodes, edges


def forward_fastg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The forward records alone, and one edge (source, target, orientation) for each linked pair of them: the first, in the file's order, without loops."""
    nodes, edges = fastg_links(spark, path)
    nodes = nodes.where(~F.col("node_id").endswith("'"))
    bare = lambda c: F.regexp_replace(c, "'$", "")
    e = edges.withColumn("source", bare("source")).withColumn("target", bare("target")).where("source <> target")
    first = e.groupBy("source", "target").agg(F.min_by("orientation", F.struct("file", "place", "n")).alias("orientation"))
    ids = nodes.select("node_id")
    return nodes, first.join(ids, first.source == ids.node_id, "left_semi").join(ids, first.target == ids.node_id, "left_semi")


def kraken2(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, taxa): taxids with a positive k-mer count, or the call itself where the line has none.

    Of lines with one seq_id the last counts; a file without lines is an error.
    """
    c = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("c"), F.monotonically_increasing_id().alias("line"))
    if c.isEmpty():
        raise ContractError([f"{path} has no lines"])
    require_none(c.where("size(c) < 3").select("line", "c"), lambda r: f"a line of {path} has too few cells: {' '.join(r['c'])}")
    c = c.groupBy(F.col("c")[1]).agg(F.max_by("c", "line").alias("c")).select("c")
    pairs = F.expr("filter(transform(split(trim(coalesce(get(c, 4), '')), ' +'), x -> struct(try_cast(split(x, ':')[0] as int) as t, try_cast(get(split(x, ':'), 1) as long) as n)), x -> x.t > 0 and x.n is not null)")
    rows = c.select(F.col("c")[0].alias("call"), F.col("c")[1].alias("seq_id"), F.col("c")[2].try_cast("int").alias("taxid"), pairs.alias("p"))
    kept = F.expr("array_sort(array_distinct(transform(filter(p, x -> aggregate(filter(p, y -> y.t = x.t), 0L, (a, y) -> a + y.n) > 0), x -> x.t)))")
    return rows.select("seq_id", F.when(F.size(kept) > 0, kept).when((F.col("call") == "C") & (F.col("taxid") > 0), F.array("taxid")).otherwise(F.array().cast("array<int>")).alias("taxa"))


def kaiju(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, taxa): the call of classified reads."""
    c = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("c"))
    require_none(c.where("size(c) < 3").select("c"), lambda r: f"a line of {path} has too few cells: {' '.join(r['c'])}")
    taxid = F.col("c")[2].try_cast("int")
    return c.select(F.col("c")[1].alias("seq_id"), F.when((F.col("c")[0] == "C") & (taxid > 0), F.array(taxid)).otherwise(F.array().cast("array<int>")).alias("taxa"))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """A headed table of text cells, every file of ``path`` with its header; blank lines are dropped.

    Repeated or empty column names and ragged rows are errors.
    """
    head = spark.read.text(path).where(F.trim("value") != "").first()
    if head is None:
        raise ContractError([f"{path} has no header"])
    names = head["value"].split("\t")
    if len(set(names)) < len(names) or "" in names:
        raise ContractError([f"{path} has an empty or repeated column name"])
    odd = "_" * (1 + max(map(len, names)))  # no column's name
    text = lambda *columns: StructType([StructField(n, StringType()) for n in columns])
    plain = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "").option("emptyValue", "")
    checked = plain.schema(text(*names, odd)).option("columnNameOfCorruptRecord", odd).csv(path)
    every = F.length(F.concat_ws("", *[F.col(f"`{n}`") for n in names])) >= 0  # all cells are asked for, since only then a row's cells are counted
    wrong = checked.where(F.col(odd).rlike(r"\S") & every).select(odd)
    require_none(wrong, lambda r: f"a row of {path} does not have {len(names)} cells: {r[0]!r}")
    cells = [F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names]
    return plain.schema(text(*names)).csv(path).select(*cells).where(F.concat(*[F.col(f"`{n}`") for n in names]).rlike(r"\S"))


def write_tsv(df: DataFrame, path: str) -> None:
    """``df`` as headed text files of one folder, nulls as empty cells and nothing quoted; cells hold no tabs or line ends."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    out = df.select(*cells)
    require_none(out.where(" or ".join(f"`{c}` rlike '[\\t\\r\\n]'" for c in df.columns)).select(df.columns[0]), lambda r: f"the row of {r[0]} has a cell with a tab or a line end")
    out.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_fasta(df: DataFrame, path: str, name: str = "node_id", sequence: str = "sequence", width: int = 80) -> None:
    """FASTA part files in ascending order of names."""
    body = F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")
    df.orderBy(name).select(F.concat(F.lit(">"), name, F.lit("\n"), body)).write.text(path)
