"""Dense layouts of compacted graphs, node classes and labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut, sized
from tessera.errors import ContractError, gathered, require_none
from tessera.functions import seq
from tessera.operators.build import Graph
from tessera.operators.compact import Compacted
from tessera.operators.ids import numbered, ranked
from tessera.operators.topology import csr_slots, pointers
from tessera.operators.transit import repeat_junction_sequences


def dense_ids(elements: DataFrame, key: str) -> DataFrame:
    """Adds dense_id: 0, 1, ... in ascending order of ``key``."""
    return ranked(elements, [key], "dense_id").withColumn("dense_id", F.col("dense_id") - 1)


def colour_masks(elements: DataFrame, palette: Sequence[int]) -> DataFrame:
    """Adds colors: a 0/1 array with a place for each colour of the palette, in its order."""
    return elements.withColumn("colors", F.array(*[F.array_contains("color_ids", F.lit(int(c))).cast("tinyint") for c in palette]))


def feature_columns(elements: DataFrame, layers: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(key, features): the named annotation layers (id, name, value) side by side; every element needs each value."""
    wide = layers.where(F.col("name").isin(list(names))).groupBy("id").pivot("name", list(names)).agg(F.first("value"))
    out = elements.select(key).join(wide, F.col(key) == F.col("id"), "left")
    lacking = out.where(" or ".join(f"`{n}` is null" for n in names)).agg(F.min(key)).first()[0]
    if lacking is not None:
        raise ContractError([f"no annotation value for {lacking}"])
    return out.select(key, F.array(*[F.col(f"`{n}`").cast("float") for n in names]).alias("features"))


def node_classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, name): a node's own values, sorted and joined by '+'; else the value that most incident links have.

    nodes (node, values), links (source, target, values). The smallest value
    wins ties, a self-loop counts once, and a node with neither is Unclassified.
    """
    ends = links.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node"), "values")
    votes = ends.select("node", F.explode("values").alias("value")).groupBy("node", "value").agg(F.count("*").alias("n"))
    best = votes.groupBy("node").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("_vote"))
    own = F.when(F.size("values") > 0, F.array_join(F.array_sort("values"), "+"))
    return nodes.join(best, "node", "left").select("node", F.coalesce(own, "_vote", F.lit("Unclassified")).alias("name"))


def genome_labels(nodes: DataFrame, genomes: DataFrame, k: int) -> DataFrame:
    """(node_id, label): the genome that alone holds a strict majority of a node's k-mers, numbered by name from 1, else 0."""
    names = genomes.select("genome_id").distinct().selectExpr("genome_id", "cast(row_number() over (order by genome_id) as long) as number")  # one row per genome
    both = genomes.select("genome_id", F.explode(F.array("seq", seq.reverse_complement(F.col("seq")))).alias("s"))
    kmers = both.select("genome_id", F.explode(F.array_distinct(seq.kmers(F.col("s"), k))).alias("kmer")).distinct()
    own = nodes.select("node_id", F.explode(seq.kmers(F.col("sequence"), k)).alias("kmer")).groupBy("node_id", "kmer").agg(F.count("*").alias("n"))
    hits = own.join(kmers, "kmer").groupBy("node_id", "genome_id").agg(F.sum("n").alias("hits"))
    most = hits.groupBy("node_id").agg(F.max("hits").alias("best"))
    top = hits.join(most, "node_id").where("hits = best").groupBy("node_id", "best").agg(F.count("*").alias("ties"), F.min("genome_id").alias("genome_id"))
    won = top.where("ties = 1").join(names, "genome_id").select("node_id", "best", "number")
    windows = F.length("sequence") - k + 1
    return nodes.join(won, "node_id", "left").select("node_id", F.when((windows > 0) & (2 * F.col("best") > windows), F.col("number")).otherwise(0).cast("long").alias("label"))


def unanimous(members: DataFrame) -> DataFrame:
    """(group, label): the label that all members share, else 0 (members: group, label)."""
    return members.groupBy("group").agg(F.when(F.min("label") == F.max("label"), F.min("label")).otherwise(0).alias("label"))


def coloured_rows(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(id, color_ids) and the dictionary (color_id, namespace, value) of attribute columns.

    rows (id, pos, columns...); colours are numbered column by column, values by
    first appearance in ``pos``; blank cells have none.
    """
    cells = rows.select("id", "pos", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(name).alias("namespace"), seq.tidy(F.coalesce(F.col(name).cast("string"), F.lit(""))).alias("value")) for i, name in enumerate(columns)])).alias("v")).select("id", "pos", "v.*").where("value <> ''")
    first = cells.groupBy("c", "namespace", "value").agg(F.min("pos").alias("pos"))
    named = ranked(first, ["c", "pos", "value"], "color_id").select((F.col("color_id") - 1).cast("int").alias("color_id"), "namespace", "value")
    sets = cells.join(named, ["namespace", "value"]).groupBy("id").agg(F.array_sort(F.collect_set("color_id")).alias("color_ids"))
    return rows.select("id").join(sets, "id", "left").select("id", F.coalesce("color_ids", F.array().cast("array<int>")).alias("color_ids")), named


@dataclass(frozen=True)
class Digraph:
    """A coloured directed graph: nodes (node_id, sequence, columns, color_ids), edges (edge_id, source, target, orientation, columns, color_ids), its dictionary and the declared types of its columns."""

    graph: Graph
    dictionary: DataFrame
    features: dict[str, dict[str, str]]


def column_types(rows: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """``float`` for a column whose filled cells are all numbers, ``str`` for another; a column without filled cells is left out.

    Every column is one aggregate: how many cells are filled, and how many of them are no numbers.
    """
    if not columns:
        return {}
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    counts = [x for i, c in enumerate(columns) for x in (F.count_if(cell(c) != "").alias(f"n{i}"), F.count_if((cell(c) != "") & F.trim(cell(c)).try_cast("double").isNull()).alias(f"t{i}"))]
    found = rows.agg(*counts).first()
    return {c: "str" if found[f"t{i}"] else "float" for i, c in enumerate(columns) if found[f"n{i}"]}


def coloured_digraph(nodes: DataFrame, edges: DataFrame, k: int, colour_columns: Sequence[str], keep_columns: Sequence[str] = ()) -> Digraph:
    """A directed graph with sequences from its junctions, coloured by columns of its rows.

    nodes (node_id, pos, ...) and edges (source, target, pos, ...); ``pos`` orders the
    rows. Colours are numbered column by column; within one, values count from
    their first sight, over the nodes and then over the edges. Edges are named in
    their order. Colour columns are kept as texts and the others with the type
    that :func:`column_types` finds; a column that an input lacks is blank there.
    """
    errors = ([] if isinstance(k, int) and k >= 2 else [f"k is {k}, and must be a whole number above 1"]) + ([] if colour_columns else ["no column gives colours"])
    if errors:
        raise ContractError(errors)
    nodes, edges = cut(nodes, "digraph-nodes"), cut(edges, "digraph-edges")
    errors = ["there are no nodes"] if nodes.isEmpty() else []
    errors += gathered(nodes.groupBy("node_id").count().where("count > 1 or coalesce(node_id, '') = ''"), lambda r: f"{r['count']} nodes are called {r['node_id']!r}")
    known = nodes.select("node_id")
    for side in ("source", "target"):
        errors += gathered(edges.join(known, edges[side] == known.node_id, "left_anti").select("pos", side), lambda r, side=side: f"the {side} {r[side]} of the edge at {r['pos']} is no node")
    if errors:
        raise ContractError(errors)
    e = cut(ranked(edges, ["pos"], "_rank").withColumn("edge_id", numbered("e", "_rank")).drop("_rank"), "digraph-edges")
    blank = F.lit("")
    own = lambda rows, c: seq.tidy(F.coalesce(F.col(f"`{c}`").cast("string"), blank)) if c in rows.columns else blank
    cells = lambda rows, key, phase: rows.select(F.lit(phase).alias("phase"), F.col(key).alias("id"), "pos", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(c).alias("namespace"), own(rows, c).alias("value")) for i, c in enumerate(colour_columns)])).alias("v")).select("phase", "id", "pos", "v.*").where("value <> ''")
    every = cut(cells(nodes, "node_id", 0).unionByName(cells(e, "edge_id", 1)), "digraph-cells")
    if every.isEmpty():
        raise ContractError(["the colour columns have no values"])
    first = every.groupBy("c", "namespace", "value").agg(F.min(F.struct("phase", "pos")).alias("at")).select("c", "namespace", "value", "at.phase", "at.pos")
    dictionary = ranked(first, ["c", "phase", "pos", "value"], "color_id").select((F.col("color_id") - 1).cast("int").alias("color_id"), "namespace", "value")
    dictionary = cut(dictionary, "digraph-colours")

    def coloured(rows: DataFrame, key: str, phase: int) -> DataFrame:
        mine = every.where(F.col("phase") == phase).join(dictionary, ["namespace", "value"]).groupBy(F.col("id").alias(key)).agg(F.array_sort(F.collect_set("color_id")).alias("color_ids"))
        return rows.join(mine, key, "left").withColumn("color_ids", F.coalesce("color_ids", F.array().cast("array<int>")))

    kept = lambda rows: {c: "str" for c in column_types(rows, [c for c in colour_columns if c in rows.columns])}
    types = {"node": {**kept(nodes), **column_types(nodes, [c for c in keep_columns if c in nodes.columns])}, "edge": {"orientation": "orientation", **kept(e)}}
    shown = lambda rows, kind: [(own(rows, c).try_cast("double") if t == "float" else own(rows, c)).alias(c) for c, t in types[kind].items() if t != "orientation"]
    sequences = repeat_junction_sequences(nodes.select(F.col("node_id").alias("node")), e.select("source", "target"), k).withColumnRenamed("node", "node_id")
    n = coloured(nodes.select("node_id", *shown(nodes, "node")), "node_id", 0).join(sequences, "node_id")

    def made() -> DataFrame:
        rows = coloured(e.select("edge_id", "source", "target", F.lit("++").alias("orientation"), *shown(e, "edge")), "edge_id", 1)
        return cut(rows.withColumn("overlap", F.lit(k - 1)), "digraph")

    return Digraph(Graph(cut(n, "digraph"), made, "de_bruijn", k), dictionary, types)


@dataclass(frozen=True)
class Layout:
    """nodes (dense_id, source_id, members, features, colors, label), slots (slot, src, dst, link_id, features, colors) and pointers (dense_id, indptr); ``rows`` are the nodes as written, without members."""

    nodes: DataFrame
    slots: DataFrame
    pointers: DataFrame
    node_features: list[str]
    edge_features: list[str]
    rows: DataFrame | None = None


def feature_names(width: int, given: Sequence[str] | None, sidecar: Sequence[str] = ()) -> list[str]:
    """Names of all places: ``f0``, ``f1``, ... or given ones for the first ``width``, then those of annotation layers."""
    own = [f"f{i}" for i in range(width)] if given is None else list(given)
    names = own if len(own) == width + len(sidecar) and given is not None else [*own, *sidecar]
    if len(names) != width + len(sidecar) or len(set(names)) < len(names):
        raise ContractError([f"{len(names)} distinct names are wanted for {width + len(sidecar)} features: {', '.join(names)}"])
    return names


def feature_registry(names: Sequence[str], explicit: int, positional: bool, sources: Sequence[tuple[str, str]] = ()) -> list[dict]:
    """What each feature column is: its name and place, and whether it was given, numbered, or comes from an annotation layer."""
    if len(names) != explicit + len(sources):
        raise ContractError([f"{len(names)} names for {explicit} given and {len(sources)} annotated features"])
    own = [{"name": n, "place": i, "origin": "positional" if positional else "explicit", "namespace": None, "source": None} for i, n in enumerate(names[:explicit])]
    return own + [{"name": n, "place": explicit + i, "origin": "annotation", "namespace": ns, "source": src} for i, (n, (ns, src)) in enumerate(zip(names[explicit:], sources, strict=True))]


def aligned(elements: DataFrame, features: DataFrame | None, key: str) -> DataFrame:
    """``elements`` with float features by key: each needs one vector, all of one width, and no vector may be left over."""
    if features is None:
        return elements.withColumn("features", F.array().cast("array<float>"))
    own = features.select(key, F.col("features").cast("array<float>").alias("features"))
    errors = gathered(elements.select(key).join(own, key, "left_anti"), lambda r: f"{r[key]} has no features")
    errors += gathered(own.select(key).join(elements, key, "left_anti"), lambda r: f"features of {r[key]}, which is not in the graph")
    errors += gathered(own.groupBy(key).count().where("count > 1").select(key), lambda r: f"{r[key]} has features twice")
    widths = [r[0] for r in own.select(F.size("features")).distinct().limit(3).collect()]
    errors += ["features differ in width"] if len(widths) > 1 else []
    if errors:
        raise ContractError(errors)
    return elements.join(own, key)


def layout(c: Compacted, node_features: DataFrame | None = None, edge_features: DataFrame | None = None, palette: Sequence[int] = (), labels: DataFrame | None = None, node_names: Sequence[str] | None = None, edge_names: Sequence[str] | None = None) -> Layout:
    """The dense layout of a compacted graph: unitigs in order of their ids, links in row order.

    Features are (unitig_id, features) and (link_id, features), labels (unitig_id,
    label) for every unitig. A link without both of its unitigs is an error.
    Members are looked up where the nodes are read; neither they nor sequences are
    ranked and written with them.
    """
    known = c.unitigs.select("unitig_id")
    slim = lambda rows, key: rows.select(key, *[x for x in rows.columns if x == "color_ids"])
    ends = c.links.select("link_id", F.explode(F.array("source", "target")).alias("unitig_id")).join(known, "unitig_id", "left_anti")
    require_none(ends.select("link_id").distinct(), lambda r: f"link {r['link_id']} has an unknown end")

    def coloured(rows: DataFrame) -> DataFrame:
        return colour_masks(rows if "color_ids" in rows.columns else rows.withColumn("color_ids", F.array().cast("array<int>")), palette) if palette else rows.withColumn("colors", F.array().cast("array<tinyint>"))

    nodes = coloured(aligned(slim(c.unitigs, "unitig_id"), node_features, "unitig_id"))
    if labels is not None:
        require_none(known.join(labels, "unitig_id", "left_anti"), lambda r: f"{r['unitig_id']} has no label")
        nodes = nodes.join(labels.select("unitig_id", F.col("label").cast("long").alias("label")), "unitig_id")
    else:
        nodes = nodes.withColumn("label", F.lit(None).cast("long"))
    nodes = cut(dense_ids(nodes, "unitig_id").select("dense_id", F.col("unitig_id").alias("source_id"), "features", "colors", "label"), "layout-nodes")
    nodes = sized(nodes)
    of = nodes.select(F.col("source_id").alias("node_id"), "dense_id")
    slots = csr_slots(c.links, of)
    links = coloured(aligned(slim(c.links, "link_id"), edge_features, "link_id")).select("link_id", "features", "colors")
    slots = cut(slots.join(links, "link_id").select("slot", "src", "dst", "link_id", "features", "colors"), "layout-slots")
    width = lambda rows: rows.agg(F.coalesce(F.max(F.size("features")), F.lit(0))).first()[0]
    whole = nodes.join(c.unitigs.select(F.col("unitig_id").alias("source_id"), "members"), "source_id").select("dense_id", "source_id", "members", "features", "colors", "label")
    return Layout(whole, slots, pointers(slots, nodes, "src"), feature_names(width(nodes), node_names), feature_names(width(slots), edge_names), nodes)


def from_rows(pointers_: DataFrame, indices: DataFrame) -> DataFrame:
    """(slot, src, dst, ...): an outside graph's rows with targets in order, whatever goes with a place moved along.

    pointers_ (dense_id, indptr) has a row for each node and one more for the
    end; indices (place, dst, ...) a row for each edge. A target that stands
    twice in a row, or pointers that do not rise from 0 to the number of edges, are errors.
    """
    spans = pointers_.select(F.col("dense_id").alias("src"), "indptr").join(pointers_.select((F.col("dense_id") - 1).alias("src"), F.col("indptr").alias("upto")), "src")
    n = indices.count()
    ends = pointers_.agg(F.min_by("indptr", "dense_id"), F.max_by("indptr", "dense_id")).first()
    errors = [] if ends[0] == 0 and ends[1] == n else [f"pointers run from {ends[0]} to {ends[1]}, and must from 0 to {n}"]
    errors += gathered(spans.where("upto < indptr").select("src"), lambda r: f"the pointers of node {r['src']} fall")
    if errors:
        raise ContractError(errors)
    places = spans.where("upto > indptr").select("src", "indptr", F.explode(F.sequence(F.col("indptr"), F.col("upto") - 1)).alias("place"))
    rows = places.join(indices, "place")
    require_none(rows.groupBy("src", "dst").count().where("count > 1").select("src", "dst"), lambda r: f"node {r['src']} has the target {r['dst']} twice")
    rest = [c for c in indices.columns if c not in ("place", "dst")]
    return rows.selectExpr("indptr + row_number() over (partition by src order by dst) - 1 as slot", "src", "dst", *rest)


def resolved(nodes: DataFrame, unitigs: DataFrame, dense: DataFrame) -> DataFrame:
    """(dense_id, source_id, sequence) of the wanted dense ids; one that the layout or the graph does not know is an error."""
    rows = dense.select("dense_id").join(nodes.select("dense_id", "source_id"), "dense_id", "left").join(unitigs.select(F.col("unitig_id").alias("source_id"), "sequence"), "source_id", "left")
    require_none(rows.where("sequence is null").select("dense_id"), lambda r: f"nothing stands behind dense id {r['dense_id']}")
    return rows.select("dense_id", "source_id", "sequence")


def geometric_states(c: Compacted, places: DataFrame) -> DataFrame:
    """(unitig_id, lon, lat, coverage): means over a unitig's members (places: node_id, lon, lat, coverage)."""
    rows = c.mapping.join(places, "node_id", "left")
    require_none(rows.where("lon is null or lat is null or coverage is null").select("node_id"), lambda r: f"node {r['node_id']} has no place or coverage")
    return rows.groupBy("unitig_id").agg(*[F.avg(x).alias(x) for x in ("lon", "lat", "coverage")])


def edge_targets(links: DataFrame, dictionary: DataFrame, namespaces: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(link_id, targets): a 0/1 place for each colour of the namespaces, in their order and that of colour ids, and the places' names."""
    order = F.expr("case " + " ".join(f"when namespace = '{n}' then {i}" for i, n in enumerate(namespaces)) + " end")
    palette = dictionary.withColumn("_o", order).where("_o is not null").orderBy("_o", "color_id").collect()  # a dictionary: one row per colour
    masks = colour_masks(links, [r["color_id"] for r in palette])
    return masks.select("link_id", F.col("colors").cast("array<int>").alias("targets")), [f"{r['namespace']}:{r['value']}" for r in palette]
