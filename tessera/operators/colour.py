"""Colourings of nodes and edges: set algebra, reads, calls, leakage, filters."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut, shuffled, sized
from tessera.errors import ContractError, require_none
from tessera.functions import seq
from tessera.functions.sets import combine, only
from tessera.operators.build import Graph
from tessera.operators.ids import ranked
from tessera.operators.kmers import sample_counts
from tessera.operators.ml import kmeans


def apply_colours(elements: DataFrame, incoming: DataFrame, key: str, operation: str) -> DataFrame:
    """``elements`` (key, color_ids, ...) with their sets combined with ``incoming`` (key, colors).

    An element that ``incoming`` does not name is cleared by replace and by
    subtract (its own colours are taken as incoming), and unchanged otherwise.
    """
    absent = {"replace": F.array().cast("array<int>"), "merge": F.col("color_ids"), "intersect": F.col("color_ids"), "subtract": F.col("color_ids")}
    if operation not in absent:
        raise ContractError([f"unknown operation {operation}"])
    joined = elements.join(incoming.select(key, F.col("colors").alias("_in")), key, "left")
    used = F.coalesce(F.col("_in"), absent[operation])
    return joined.withColumn("color_ids", combine(F.col("color_ids"), used, operation)).drop("_in")


def fresh_ids(values: DataFrame, first: int) -> DataFrame:
    """(value, color_id): new ids from ``first`` on, by first appearance (values: value, phase, pos), equal places by value."""
    seen = values.groupBy("value").agg(F.min(F.struct("phase", "pos")).alias("at")).select("value", "at.phase", "at.pos")
    return ranked(seen, ["phase", "pos", "value"], "color_id").select("value", (F.col("color_id") - 1 + first).cast("int").alias("color_id"))


def filter_colours(elements: DataFrame, dictionary: DataFrame, namespaces: Sequence[str] | None = None, ids: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Elements and dictionary with only the colours of the given namespaces and ids; topology stays."""
    keep = dictionary
    if namespaces is not None:
        keep = keep.where(F.col("namespace").isin(list(namespaces)))
    if ids is not None:
        known = {r["color_id"] for r in dictionary.where(F.col("color_id").isin(list(ids))).select("color_id").collect()}
        if missing := sorted(set(ids) - known):
            raise ContractError([f"unknown colour id {i}" for i in missing])
        keep = keep.where(F.col("color_id").isin(list(ids)))
    one = keep.agg(F.coalesce(F.collect_set("color_id"), F.array().cast("array<int>")).alias("_keep"))
    return elements.crossJoin(F.broadcast(one)).withColumn("color_ids", only(F.col("color_ids"), F.col("_keep"))).drop("_keep"), keep


def require_samples(reads: DataFrame, samples: DataFrame) -> None:
    """Raises where a read's sample is none of ``samples`` (sample_id), a null one included."""
    lost = reads.select("sample_id").distinct().join(samples, reads.sample_id == samples.sample_id, "left_anti")
    require_none(lost, lambda r: f"read sample {r['sample_id']} is not in the dictionary")


def colour_nodes_by_reads(nodes: DataFrame, reads: DataFrame, k: int, min_depth: int = 1) -> DataFrame:
    """(node_id, sample_id, depth): reads of a sample that hold a k-letter node on either strand.

    A read counts once for a node. Windows are counted by sample in their
    canonical form, which both strands share, before they meet the nodes. A read
    shorter than k covers a node that holds it, which is found by the windows of
    that length.
    """
    if min_depth < 1:
        raise ContractError(["min_vertex_depth must be >= 1"])
    n = nodes.select("node_id", F.col("sequence").alias("kmer"))
    own = n.select("node_id", seq.canonical(F.col("kmer")).alias("kmer"))
    hits = own.join(shuffled(sample_counts(reads, k, by_read=True)), "kmer").select("node_id", "sample_id", "n")
    short = reads.where((F.length("seq") < k) & (F.length("seq") > 0))
    sizes = [r[0] for r in short.select(F.length("seq")).distinct().collect()]  # fewer than k lengths
    if sizes:
        counts = cut(short.groupBy("sample_id", seq.canonical(F.col("seq")).alias("w")).agg(F.count("*").alias("n")), "short")
        windows = F.concat(*[seq.kmers(F.col("kmer"), size) for size in sizes])
        inside = n.select("node_id", F.explode(F.array_distinct(F.transform(windows, seq.canonical))).alias("w"))
        hits = hits.unionByName(inside.join(counts, "w").select("node_id", "sample_id", "n"))
    return hits.groupBy("node_id", "sample_id").agg(F.sum("n").alias("depth")).where(F.col("depth") >= min_depth)


def _require_density(min_density: int) -> None:
    if min_density < 1:
        raise ContractError(["min_edge_kmer_density must be >= 1"])


def colour_edges_by_reads(edges: DataFrame, nodes: DataFrame, reads: DataFrame, k: int, min_density: int = 2) -> DataFrame:
    """(edge_id, sample_id, density): occurrences of an edge's (k+1)-mer in a sample, on either strand; an unknown orientation is an error."""
    _require_density(min_density)
    o = F.when(F.coalesce("orientation", F.lit("")) == "", "++").otherwise(F.col("orientation"))
    require_none(edges.where(~o.isin("++", "+-", "-+", "--")).select("edge_id", "orientation"), lambda r: f"edge {r['edge_id']} has the orientation {r['orientation']}")
    s = nodes.select(F.col("node_id").alias("source"), F.col("sequence").alias("_l"))
    t = nodes.select(F.col("node_id").alias("target"), F.col("sequence").alias("_r"))
    e = edges.join(s, "source").join(t, "target")
    motif = seq.junction(seq.oriented(F.col("_l"), F.left(o, F.lit(1))), seq.oriented(F.col("_r"), F.right(o, F.lit(1))), k)
    return colour_motifs_by_reads(e.select("edge_id", motif.alias("motif")), reads, k, min_density)


def colour_motifs_by_reads(motifs: DataFrame, reads: DataFrame, k: int, min_density: int = 2) -> DataFrame:
    """:func:`colour_edges_by_reads` for edges given with the k + 1 letters across them (edge_id, motif)."""
    _require_density(min_density)
    found = motifs.select("edge_id", seq.canonical(F.col("motif")).alias("kmer")).join(shuffled(sample_counts(reads, k + 1, by_read=False)), "kmer")
    return found.select("edge_id", "sample_id", F.col("n").alias("density")).where(F.col("density") >= min_density)


def colour_from_calls(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(edge_id, values): sorted intersection, as strings, of the ends' call sets (calls: node_id, taxon)."""
    sets = calls.groupBy("node_id").agg(F.collect_set(F.col("taxon").cast("string")).alias("v"))
    s = sets.select(F.col("node_id").alias("source"), F.col("v").alias("_l"))
    t = sets.select(F.col("node_id").alias("target"), F.col("v").alias("_r"))
    return edges.join(s, "source").join(t, "target").select("edge_id", F.array_sort(F.array_intersect("_l", "_r")).alias("values"))


def decaying_mass(evidence: DataFrame, edges: DataFrame, decay: float = 0.5, iterations: int = 4) -> DataFrame:
    """(node, colour, mass) after leakage along edges.

    evidence (node, colour, weight) is normalised per node. Each round a node
    reads the weighted mean of its out-neighbours that have mass, mixes it with
    its own evidence and is normalised again; without such a vote it returns to
    its evidence. Edges (source, target[, weight]) need a positive weight.
    """
    errors = [] if 0 <= decay <= 1 else [f"decay is {decay}, and must lie between 0 and 1"]
    errors += [] if iterations >= 1 else [f"iterations is {iterations}, and must be 1 or more"]
    if errors:
        raise ContractError(errors)

    def normal(rows: DataFrame) -> DataFrame:
        """The masses above 0, each over its node's sum; ``part`` numbers stretches of a node's colours."""
        rows = rows.where("mass > 0 and node is not null")
        return rows.selectExpr("node", "colour", "mass / sum(mass) over (partition by node) as mass", f"(row_number() over (partition by node order by colour) - 1) div {STRETCH} as part")

    own = cut(normal(evidence.groupBy("node", "colour").agg(F.sum("weight").cast("double").alias("mass"))), "evidence")
    known = evidence.select("node").distinct()
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    links = cut(edges.select(F.col("source").alias("node"), F.col("target").alias("other"), weight.alias("w")).where("w > 0").join(known, "node", "left_semi"), "links")
    zero, state = F.lit(0.0), own
    for _ in range(iterations):
        # a link carries a stretch of its target's colours as one row
        cells = F.array_sort(F.collect_list(F.struct("colour", "mass")))
        held = state.groupBy(F.col("node").alias("other"), "part").agg(cells.alias("c")).select("other", F.col("c.colour").alias("colours"), F.col("c.mass").alias("masses"))
        sent = shuffled(links).join(shuffled(held), "other").select("node", "colours", F.transform("masses", lambda x: F.col("w") * x).alias("v")).repartition("node")
        sent = sent.select("node", F.explode(F.arrays_zip(F.col("colours").alias("colour"), F.col("v").alias("v"))).alias("x"))
        votes = sent.groupBy("node", F.col("x.colour").alias("colour")).agg(F.sum("x.v").alias("v"))
        both = votes.select("node", "colour", "v", zero.alias("own")).unionByName(own.select("node", "colour", zero.alias("v"), F.col("mass").alias("own")))
        both = both.groupBy("node", "colour").agg(F.sum("v").alias("v"), F.sum("own").alias("own"))
        # the masses of a node sum to 1, so its votes sum to the weight of the links that vote
        mixed = both.selectExpr("node", "colour", "own", "v", "sum(v) over (partition by node) as _w")
        mixed = mixed.select("node", "colour", F.when(F.col("_w") > 0, decay * F.col("v") / F.col("_w") + (1 - decay) * F.col("own")).otherwise(F.col("own")).alias("mass"))
        state = cut(normal(mixed), "mass")
    return state.select("node", "colour", "mass")


def decaying_colours(mass: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(node, colours): colours with at least ``threshold`` mass, else the heaviest (the smallest of equals)."""
    kept = F.array_sort(F.collect_set(F.when(F.col("mass") >= threshold, F.col("colour"))))
    best = F.min_by("colour", F.struct(-F.col("mass"), F.col("colour")))
    return mass.where("mass > 0").groupBy("node").agg(kept.alias("_k"), best.alias("_b")).select("node", F.when(F.size("_k") > 0, F.col("_k")).otherwise(F.array("_b")).alias("colours"))


def composition(nodes: DataFrame, k: int = 4) -> DataFrame:
    """(node_id, kmer, x): L2-normalised counts of canonical k-mers; windows with N are skipped."""
    w = nodes.select("node_id", F.explode(seq.kmers(F.col("sequence"), k)).alias("kmer")).where(~F.col("kmer").contains("N"))
    n = w.groupBy("node_id", seq.canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))
    norm = n.groupBy("node_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_l"))
    return n.join(norm, "node_id").select("node_id", "kmer", (F.col("n") / F.col("_l")).alias("x"))


def facet_frames(elements: DataFrame, dictionary: DataFrame, facet: str, shown: str, reduce: Column) -> DataFrame:
    """(level, id, value): for each colour of the facet namespace, what ``shown`` gives for elements that hold it.

    ``reduce`` is an aggregate over the column ``value`` of the shown namespace;
    elements without the level, or with nothing to show, get a null.
    """
    has = elements.select("id", F.explode("color_ids").alias("color_id")).join(dictionary, "color_id")
    levels = dictionary.where(F.col("namespace") == facet).select(F.col("value").alias("level")).distinct()
    value = has.where(F.col("namespace") == shown).groupBy("id").agg(reduce.alias("value"))
    inside = has.where(F.col("namespace") == facet).select("id", F.col("value").alias("level")).distinct().join(value, "id", "left")
    return elements.select("id").crossJoin(F.broadcast(levels)).join(inside, ["id", "level"], "left").select("level", "id", "value")


def paint(elements: DataFrame, values: DataFrame, dictionary: DataFrame, namespace: str, operation: str = "merge") -> tuple[DataFrame, DataFrame]:
    """Elements (id, color_ids) coloured with new colours of ``namespace``, and the longer dictionary.

    values (id, value, pos) gives each element its values; colours are numbered
    on from the dictionary's largest id in order of first appearance. They are
    always new, even where the dictionary has the same value, so intersect
    empties painted elements and subtract leaves them. Replace starts a new
    dictionary from 0.
    """
    start = 0 if operation == "replace" else dictionary.agg(F.coalesce(F.max("color_id"), F.lit(-1))).first()[0] + 1
    named = fresh_ids(values.select("value", F.lit(0).alias("phase"), "pos"), start)
    given = values.join(named, "value").groupBy("id").agg(F.array_sort(F.collect_set("color_id")).alias("colors"))
    new = named.select("color_id", F.lit(namespace).alias("namespace"), "value")
    return apply_colours(elements, given, "id", operation), new if operation == "replace" else dictionary.unionByName(new)


#: Colours of a node that travel together.
STRETCH = 1024

#: Letters of a seed by which a sequence is looked for in longer ones.
SEED = 16


def _rarest(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small, off, seed, _small): for each text of ``small`` with SEED letters or more its window that ``large`` has least often, and where it begins.

    A text of which a window is nowhere in ``large`` is in none of its texts, and
    goes. Ties go by the place.
    """
    windows = lambda rows: rows.where(F.length("s") >= SEED).select("id", F.posexplode(seq.kmers(F.col("s"), SEED)).alias("off", "seed"))
    own = cut(windows(small), "seeds")
    counts = windows(large).join(shuffled(own.select("seed").distinct()), "seed", "left_semi").groupBy("seed").agg(F.count("*").alias("n"))
    met = own.join(shuffled(counts), "seed", "left")
    best = met.groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "seed")).alias("b")).where("b.n > 0")
    return shuffled(best).join(small, "id").select(F.col("id").alias("small"), "b.off", "b.seed", F.col("s").alias("_small"))


def _inside(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small, large): pairs of (id, s) rows in which the one's text stands in the other's.

    A text of SEED letters or more is looked for by the rarest of its windows, so
    repeats that many texts hold are no keys; a shorter one is a window itself.
    The whole text is compared where the windows meet.
    """
    n = F.length("s")
    part = _rarest(small, large)
    at = large.where(n >= SEED).select(F.col("id").alias("large"), F.posexplode(seq.kmers(F.col("s"), SEED)).alias("at", "seed"))
    text = large.select(F.col("id").alias("large"), F.col("s").alias("_large"))
    met = shuffled(at).join(part, "seed").where("at >= off").join(shuffled(text), "large")
    found = met.where(F.substring("_large", F.col("at") - F.col("off") + 1, F.length("_small")) == F.col("_small")).select("small", "large")
    # written, so that its size is known: windows of the longer texts are only shuffled if there is much to look for
    short = sized(cut(small.where((n > 0) & (n < SEED)).select(F.col("id").alias("small"), F.col("s").alias("seed")), "short"))
    sizes = [r[0] for r in short.select(F.length("seed")).distinct().collect()]  # fewer than SEED lengths
    if sizes:
        windows = large.select(F.col("id").alias("large"), F.explode(F.array_distinct(F.concat(*[seq.kmers(F.col("s"), size) for size in sizes]))).alias("seed"))
        found = found.unionByName(windows.join(short, "seed").select("small", "large"))
    return found


def colour_any_nodes_by_reads(nodes: DataFrame, reads: DataFrame, min_depth: int = 1) -> DataFrame:
    """(node_id, sample_id, depth) for nodes of any length: reads of a sample that hold the node, or that a longer node holds, on either strand."""
    if min_depth < 1:
        raise ContractError([f"min_depth is {min_depth}, and must be 1 or more"])
    strands = reads.where("seq <> ''").select(F.col("read_id").alias("id"), F.explode(F.array_distinct(F.array("seq", seq.reverse_complement(F.col("seq"))))).alias("s"))
    plain = nodes.select(F.col("node_id").alias("id"), F.col("sequence").alias("s"))
    held = _inside(plain, strands).select(F.col("small").alias("node_id"), F.col("large").alias("read_id"))
    holding = _inside(strands, plain).select(F.col("large").alias("node_id"), F.col("small").alias("read_id"))
    hits = shuffled(held.unionByName(holding).distinct()).join(reads.select("read_id", "sample_id"), "read_id")
    return hits.groupBy("node_id", "sample_id").agg(F.count("*").alias("depth")).where(F.col("depth") >= min_depth)


def colour_by_accession(nodes: DataFrame, edges: DataFrame, reads: DataFrame, k: int, min_depth: int = 1, min_density: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges coloured by the accession in the reads' names instead of their samples (reads: read_id, seq)."""
    own = reads.select("read_id", seq.accession(F.col("read_id")).alias("sample_id"), "seq")
    return colour_any_nodes_by_reads(nodes, own, min_depth), colour_edges_by_reads(edges, nodes, own, k, min_density)


def composition_vectors(nodes: DataFrame, k: int = 4) -> DataFrame:
    """(node_id, features): the shares of :func:`composition` as a vector over all canonical k-mers in order; zeros for a node without windows."""
    every = sorted({min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for w in map("".join, itertools.product("ACGT", repeat=k))})
    shares = composition(nodes, k).groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("kmer", "x"))).alias("_m"))  # at most one entry for each k-mer
    values = F.array(*[F.coalesce(F.try_element_at("_m", F.lit(w)), F.lit(0.0)) for w in every])
    return nodes.select("node_id").join(shares, "node_id", "left").select("node_id", values.alias("features"))


def colour_by_composition(nodes: DataFrame, edges: DataFrame, k: int = 4, clusters: int = 8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(node_id, value) and (edge_id, value): ``cluster_<i>`` of each node by k-means on its composition, and of edges whose ends share it."""
    ids = cut(ranked(composition_vectors(nodes, k), ["node_id"], "node"), "composition")
    of = kmeans(ids.select("node", "features"), clusters, seed).select("node", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("value"))
    named = cut(ids.join(of, "node").select("node_id", "value"), "clusters")
    return named, shared_values(edges, named)


def shared_values(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(edge_id, value): the value that both ends of an edge have (values: node_id, value)."""
    s, t = (values.select(F.col("node_id").alias(side), F.col("value").alias(name)) for side, name in (("source", "_l"), ("target", "_r")))
    return edges.join(s, "source").join(t, "target").where("_l = _r").select("edge_id", F.col("_l").alias("value"))


@dataclass(frozen=True)
class Colouring:
    """A way to colour: the namespace of its colours, the inputs that it needs, and what gives (node_id, value) and (edge_id, value) from a graph and those."""

    namespace: str
    needs: tuple[str, ...]
    run: Callable[[Graph, dict], tuple[DataFrame, DataFrame]]


def _pairs(nodes: DataFrame, edges: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    return nodes.select("node_id", F.col(column).alias("value")), edges.select("edge_id", F.col(column).alias("value"))


def _by_calls(g: Graph, given: dict) -> tuple[DataFrame, DataFrame]:
    nodes = given["calls"].select("node_id", F.col("taxon").cast("string").alias("value")).distinct()
    return nodes, colour_from_calls(g.edges, given["calls"]).select("edge_id", F.explode("values").alias("value"))


def _by_decay(g: Graph, given: dict) -> tuple[DataFrame, DataFrame]:
    evidence = given["calls"].select(F.col("node_id").alias("node"), F.col("taxon").cast("string").alias("colour"), F.lit(1.0).alias("weight"))
    nodes = decaying_colours(decaying_mass(evidence, g.edges)).select(F.col("node").alias("node_id"), F.explode("colours").alias("value"))
    return nodes, colour_from_calls(g.edges, nodes.withColumnRenamed("value", "taxon")).select("edge_id", F.explode("values").alias("value"))


#: Colourings by name, in the order in which they are tried.
COLOURINGS: dict[str, Colouring] = {
    "reads": Colouring("sample", ("reads", "k"), lambda g, x: _pairs(colour_nodes_by_reads(g.nodes, x["reads"], x["k"]), colour_edges_by_reads(g.edges, g.nodes, x["reads"], x["k"]), "sample_id")),
    "accession": Colouring("accession", ("reads", "k"), lambda g, x: _pairs(*colour_by_accession(g.nodes, g.edges, x["reads"], x["k"]), "sample_id")),
    "calls": Colouring("taxon", ("calls",), _by_calls),
    "composition": Colouring("composition", (), lambda g, _: colour_by_composition(g.nodes, g.edges)),
    "decaying": Colouring("taxon", ("calls",), _by_decay),
}


def _known(names: Sequence[str]) -> list[str]:
    if unknown := [n for n in names if n not in COLOURINGS]:
        raise ContractError([f"{n} is no colouring" for n in unknown])
    return list(dict.fromkeys(names))


def namespaces_for(names: Sequence[str]) -> list[str]:
    """Namespaces of the named colourings, each once, in the order of the names."""
    return list(dict.fromkeys(COLOURINGS[n].namespace for n in _known(names)))


def available(inputs: dict) -> list[str]:
    """Colourings for which the inputs (reads, k, calls) are there, in the registry's order."""
    return [n for n, c in COLOURINGS.items() if all(inputs.get(x) is not None for x in c.needs)]


def colour(graph: Graph, dictionary: DataFrame, names: Sequence[str], inputs: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node_id, color_ids), (edge_id, color_ids) and the dictionary after the named colourings, in the registry's order.

    The first one replaces what there is where nothing is coloured yet, and all
    others are merged in. One whose inputs are missing is an error, and so is a
    read whose sample is not among the input ``samples``, if there is one.
    """
    wanted = _known(names)
    if lacking := [n for n in wanted if n not in available(inputs)]:
        raise ContractError([f"colouring {n} needs {' and '.join(COLOURINGS[n].needs)}" for n in lacking])
    if "reads" in wanted and inputs.get("samples") is not None:
        require_samples(inputs["reads"], inputs["samples"])
    none = F.array().cast("array<int>")
    nodes, edges = (rows.select(F.col(key).alias("id"), (F.col("color_ids") if "color_ids" in rows.columns else none).alias("color_ids")) for rows, key in ((graph.nodes, "node_id"), (graph.edges, "edge_id")))
    kinds = [F.lit(k) for k in ("node", "edge")]
    state = cut(nodes.select(kinds[0].alias("kind"), "*").unionByName(edges.select(kinds[1].alias("kind"), "*")), "colours")
    for name in (n for n in COLOURINGS if n in wanted):
        values = [v.toDF("id", "value").select(kind.alias("kind"), F.col("id").cast("string").alias("id"), F.col("value").cast("string").alias("value")) for v, kind in zip(COLOURINGS[name].run(graph, inputs), kinds, strict=True)]
        both = values[0].unionByName(values[1]).where("value is not null").distinct()
        keyed = state.select(F.struct("kind", F.col("id").cast("string").alias("id")).alias("id"), "color_ids")
        given = both.select(F.struct("kind", "id").alias("id"), "value", F.struct("value", "kind", "id").alias("pos"))
        painted, dictionary = paint(keyed, given, dictionary, COLOURINGS[name].namespace, operation_for(state))
        state, dictionary = cut(painted.select("id.kind", F.col("id.id").alias("id"), "color_ids"), "colours"), cut(dictionary, "dictionary")
    part = lambda kind, key: state.where(F.col("kind") == kind).select(F.col("id").alias(key), "color_ids")
    return part("node", "node_id"), part("edge", "edge_id"), dictionary


def operation_for(elements: DataFrame) -> str:
    """How a colouring is added: ``merge`` where an element has colours already, else ``replace``."""
    return "merge" if not elements.where(F.size("color_ids") > 0).isEmpty() else "replace"
