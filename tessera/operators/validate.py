"""Validation as queries: every rule gives rows (rule, at, message), all are reported."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.errors import ContractError, gathered
from tessera.operators.compact import Compacted

ORIENTATIONS = ("++", "+-", "-+", "--")


def _said(rows: DataFrame, rule: int, at: str, message: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(at).cast("string").alias("at"), message.alias("message"))


def graph_violations(nodes: DataFrame, edges: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """(rule, at, message) for nodes (node_id, sequence[, color_ids]) and edges (edge_id, source, target[, orientation, color_ids])."""
    n = nodes.groupBy("node_id").agg(F.count("*").alias("n"))
    e = edges.groupBy("edge_id").agg(F.count("*").alias("n"))
    out = [
        _said(n.where("coalesce(node_id, '') = ''"), 1, "node_id", F.lit("empty node_id")),
        _said(n.where("n > 1"), 2, "node_id", F.concat(F.lit("duplicate node_id "), "node_id")),
        _said(nodes.where("coalesce(sequence, '') = ''"), 3, "node_id", F.concat(F.lit("node "), "node_id", F.lit(" has no sequence"))),
        _said(nodes.where("sequence <> '' and not sequence rlike '^[ACGTN]+$'"), 4, "node_id", F.concat(F.lit("node "), "node_id", F.lit(" has letters outside ACGTN"))),
        _said(e.where("n > 1"), 5, "edge_id", F.concat(F.lit("duplicate edge_id "), "edge_id")),
    ]
    for rule, side in ((6, "source"), (7, "target")):
        dangling = edges.join(nodes.select(F.col("node_id").alias(side)), side, "left_anti")
        out.append(_said(dangling, rule, "edge_id", F.concat(F.lit("edge "), "edge_id", F.lit(f" has an unknown {side} "), F.coalesce(side, F.lit("")))))
    if "orientation" in edges.columns:
        odd = edges.where(F.col("orientation").isNotNull() & ~F.col("orientation").isin(*ORIENTATIONS))
        out.append(_said(odd, 8, "edge_id", F.concat(F.lit("edge "), "edge_id", F.lit(" has orientation "), "orientation")))
    if colors is not None:
        for rule, kind, key, rows in ((9, "node", "node_id", nodes), (10, "edge", "edge_id", edges)):
            if "color_ids" in rows.columns:
                used = rows.select(key, F.explode("color_ids").alias("color_id")).join(colors, "color_id", "left_anti")
                out.append(_said(used, rule, key, F.concat(F.lit(f"{kind} "), key, F.lit(" uses the undefined colour "), F.col("color_id").cast("string"))))
    return reduce(DataFrame.unionByName, out)


def require_valid(violations: DataFrame, most: int = 1000) -> None:
    """Raises with the violations in rule order; a message list longer than ``most`` ends in a count."""
    n = violations.count()
    if n:
        rows = violations.orderBy("rule", "at", "message").limit(most).collect()
        raise ContractError([r["message"] for r in rows] + ([f"and {n - most} more"] if n > most else []))


# Parts of column and feature names, and colour namespaces, that would give a target away.
LEAKING = ("truth_taxon", "truth_taxon_id", "expected_action", "genome_abundance", "target_metric", "gold_standard", "gold_taxon")
NAMESPACES = ("truth", "gold", "target", "expected_action")


def leaking_names(names: Iterable[str]) -> list[str]:
    """Those of the names, of columns or of a layout's features, that would give a target away."""
    return [n for n in names if any(w in n.lower() for w in LEAKING)]


def leaking_columns(df: DataFrame) -> list[str]:
    return leaking_names(df.columns)


def leaking_namespaces(dictionary: DataFrame) -> DataFrame:
    """(namespace): those of a colour dictionary that would give a target away."""
    return dictionary.where(F.lower("namespace").isin(*NAMESPACES)).select("namespace").distinct()


def leaks(metadata: dict, nodes: DataFrame, edges: DataFrame, dictionary: DataFrame | None = None) -> list[str]:
    """What gives a target away in a graph: declared features, columns of its tables, namespaces of its colours."""
    declared = [name for kind in ("node", "edge") for name in (metadata.get("features") or {}).get(kind) or {}]
    found = [f"column {n} gives a target away" for n in dict.fromkeys(leaking_names([*declared, *nodes.columns, *edges.columns]))]
    if dictionary is not None:
        found += gathered(leaking_namespaces(dictionary), lambda r: f"colour namespace {r['namespace']} gives a target away")
    return found


DTYPE_PATTERNS = {
    "int": r"^-?\d+$", "label": r"^-?\d+$", "float": r"^-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$", "str": r"^[\s\S]*$", "orientation": r"^(\+\+|\+-|-\+|--)$",
    "color_set": r"^(\s*\d+\s*(,\s*\d+\s*)*)?$",
}
STORED_ELSEWHERE = ("length", "sequence_length")


def metadata_errors(metadata: dict, version: str = "1.0") -> list[str]:
    """What a graph's metadata lack: a supported version, required keys, k, and known feature types."""
    errors = [f"schema version {metadata.get('schema_version')} is not supported"] if str(metadata.get("schema_version", "")) != version else []
    errors += [f"metadata lack {key}" for key in ("graph_id", "graph_type") if not metadata.get(key)]
    k = metadata.get("k")
    if metadata.get("graph_type") == "de_bruijn" and (not isinstance(k, int) or isinstance(k, bool) or k < 1):
        errors.append("a de Bruijn graph needs a whole k above 0")
    for kind, features in (metadata.get("features") or {}).items():
        errors += [f"{kind} feature {name} has the unknown type {dtype}" for name, dtype in features.items() if dtype not in DTYPE_PATTERNS]
    return errors


def _fixed(like: DataFrame, rule: int, errors: list[str]) -> DataFrame:
    return like.sparkSession.createDataFrame([(rule, "", e) for e in errors], "rule int, at string, message string")


def _cells(rows: DataFrame, key: str, features: dict[str, str], skip: tuple[str, ...], rule: int, kind: str) -> list[DataFrame]:
    """Columns that are not declared, declared ones that are missing, and cells of another type."""
    own = [c for c in rows.columns if c not in skip]
    errors = [f"{kind} column {c} is not allowed: it follows from the sequence" for c in own if c in STORED_ELSEWHERE]
    errors += [f"{kind} column {c} is not declared" for c in own if c not in features and c not in STORED_ELSEWHERE]
    errors += [f"{kind} feature {c} has no column" for c in features if c not in own]
    out = [_fixed(rows, rule, errors)]
    for c in own:
        if c in features and features[c] in DTYPE_PATTERNS:
            cell = F.coalesce(F.col(f"`{c}`"), F.lit(""))
            fits = F.trim(cell).rlike(DTYPE_PATTERNS[features[c]])
            wrong = rows.where(~(fits | (F.trim(cell) == "")) if features[c] == "label" else ~fits)  # a label may be missing
            out.append(_said(wrong, rule, key, F.concat(F.lit(f"{kind} "), key, F.lit(f" has a {c} that is no {features[c]}"))))
    return out


def _ids(rows: DataFrame, what: str, rule: int, needs: tuple[str, ...]) -> list[DataFrame]:
    """Rules of a dictionary: whole numbers as ids, each once, and the columns that name an entry."""
    key = f"{what}_id"
    if key not in rows.columns:
        return [_fixed(rows, rule, [f"the {what} dictionary has no {key}"])]
    text = rows.select(F.trim(F.col(key).cast("string")).alias(key))
    lacking = [f"the {what} dictionary has no {c}" for c in needs if c not in rows.columns and not (c == "value" and what == "color" and "name" in rows.columns)]
    return [
        _fixed(rows, rule, lacking),
        _said(text.where(f"not coalesce({key}, '') rlike '^-?[0-9]+$'"), rule, key, F.concat(F.lit(f"{key} is no number: "), F.coalesce(key, F.lit("")))),
        _said(text.groupBy(key).count().where("count > 1"), rule, key, F.concat(F.lit(f"{key} stands twice: "), key)),
    ]


def table_violations(metadata: dict, nodes: DataFrame, sequences: DataFrame, edges: DataFrame, colors: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(rule, at, message) of a graph's tables of text cells, sequences (id, seq) and dictionaries.

    Rules in order: metadata; heads of the tables; :func:`graph_violations`;
    sequences without a node; cells and columns; dictionaries; references into them.
    """
    features = metadata.get("features") or {}
    of_node, of_edge = features.get("node") or {}, features.get("edge") or {}
    heads = [] if nodes.columns[:1] == ["node_id"] else ["the first column of nodes is not node_id"]
    heads += [] if edges.columns[:3] == ["edge_id", "source", "target"] else ["the first columns of edges are not edge_id, source, target"]
    if heads:
        return _fixed(nodes, 1, metadata_errors(metadata) + heads)
    joined = nodes.join(sequences.select(F.col("id").alias("node_id"), F.col("seq").alias("sequence")), "node_id", "left")
    out = [
        _fixed(nodes, 0, metadata_errors(metadata) + (["the graph has no node"] if nodes.isEmpty() else [])),
        graph_violations(joined.select("node_id", "sequence"), edges.select("edge_id", "source", "target")),
        _said(sequences.join(nodes.select(F.col("node_id").alias("id")), "id", "left_anti"), 11, "id", F.concat(F.lit("sequence "), "id", F.lit(" has no node"))),
        *_cells(nodes, "node_id", of_node, ("node_id",), 12, "node"),
        *_cells(edges, "edge_id", of_edge, ("edge_id", "source", "target"), 13, "edge"),
    ]
    known = {}
    for what, rows, rule, needs in (("color", colors, 14, ("value",)), ("label", labels, 15, ("namespace", "value"))):
        if rows is not None:
            out += _ids(rows, what, rule, needs)
            known[what] = rows.select(F.trim(F.col(f"{what}_id").cast("string")).alias("ref")) if f"{what}_id" in rows.columns else None
    for kind, key, rows, rule in (("node", "node_id", nodes, 16), ("edge", "edge_id", edges, 17)):
        refs = [("color", c, F.explode(F.split(F.col(c), ","))) for c in ("color_set", "colors") if c in rows.columns] + [("label", "label", F.col("label"))] * ("label" in rows.columns)
        for what, c, ref in refs:
            used = rows.where(F.trim(c) != "").select(key, ref.alias("ref")).select(key, F.trim("ref").alias("ref"))
            lost = used if known.get(what) is None else used.join(known[what], "ref", "left_anti")
            out.append(_said(lost, rule, key, F.concat(F.lit(f"{kind} "), key, F.lit(f" uses the undefined {what} "), "ref")))
    return reduce(DataFrame.unionByName, out)


def compacted_violations(metadata: dict, c: Compacted, colors: DataFrame | None = None) -> DataFrame:
    """(rule, at, message) of a compacted graph.

    Unitigs: unique ids, sequences, counts of members, inner edges, overlaps and
    colour groups, one owner for each member. Links: unique ids, known ends and
    orientations, edge ids unique over links and inner edges. Mapping: one row
    for each member, its place, lengths that tile the sequence. Colours: defined,
    and a unitig's the union of its members'.
    """
    u, links, mapping = c.unitigs, c.links, c.mapping
    k, kind, identity = metadata.get("k"), metadata.get("graph_type"), metadata.get("compaction") == "identity"
    whole_k = isinstance(k, int) and not isinstance(k, bool) and k > 0
    fixed = [f"schema version {metadata.get('schema_version')} is not supported"] if str(metadata.get("schema_version", "")) != "1.0" else []
    fixed += [] if kind else ["metadata lack graph_type"]
    fixed += ["a de Bruijn graph needs a whole k above 0"] if kind == "de_bruijn" and not whole_k else ["k is no whole number above 0"] if k is not None and not whole_k else []
    out = [_fixed(u, 0, fixed)]

    def add(rows: DataFrame, rule: int, at: str, message: str) -> None:
        out.append(_said(rows, rule, at, F.concat(F.lit(f"{message}: "), F.coalesce(F.col(at).cast("string"), F.lit("")))))

    joints = F.greatest(F.size("members") - 1, F.lit(0))
    add(u.groupBy("unitig_id").count().where("count > 1"), 1, "unitig_id", "repeated unitig")
    add(u.where("not coalesce(sequence, '') rlike '^[ACGTN]+$'"), 2, "unitig_id", "no sequence over ACGTN in unitig")
    if kind == "de_bruijn" and whole_k:
        add(u.where(F.length("sequence") < k), 3, "unitig_id", "unitig shorter than k")
    add(u.where((F.size("internal_overlaps") > 0) & (F.size("internal_overlaps") != joints)), 4, "unitig_id", "overlaps do not match the members of unitig")
    add(u.where(F.size("internal_edge_ids") != joints), 5, "unitig_id", "inner edges do not match the members of unitig")
    if "internal_edge_colors" in u.columns:
        add(u.where(F.size("internal_edge_colors") != F.size("internal_edge_ids")), 6, "unitig_id", "colours do not match the inner edges of unitig")
    if identity:
        add(u.where(F.size("members") != 1), 7, "unitig_id", "more than one member without compaction in unitig")
    add(u.where(F.size("members") == 0), 8, "unitig_id", "no members in unitig")
    member = u.select("unitig_id", F.posexplode("members").alias("place", "node_id"))
    add(links.groupBy("link_id").count().where("count > 1"), 10, "link_id", "repeated link")
    ends = links.select("link_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("unitig_id"))
    add(ends.join(u, "unitig_id", "left_anti").select("link_id").distinct(), 11, "link_id", "unknown end of link")
    add(links.where(F.col("orientation").isNotNull() & ~F.col("orientation").isin(*ORIENTATIONS)), 12, "link_id", "unknown orientation of link")
    inner = u.select("unitig_id", F.explode("internal_edge_ids").alias("edge_id"))
    add(inner.where("edge_id = ''"), 13, "unitig_id", "inner edge without an id in unitig")
    every = inner.where("edge_id <> ''").select("edge_id", F.lit(1).alias("inner")).unionByName(links.select(F.col("link_id").alias("edge_id")).distinct().withColumn("inner", F.lit(0)))
    add(every.groupBy("edge_id").agg(F.count("*").alias("n"), F.max("inner").alias("inner")).where("n > 1 and inner = 1"), 14, "edge_id", "repeated edge")
    # members and mapping meet once, for all rules that hold one against the other
    met = member.withColumn("_held", F.lit(True)).join(mapping.withColumnRenamed("unitig_id", "owner").withColumn("_mapped", F.lit(True)), "node_id", "full")
    met = cut(met, "placed-members")
    seen = met.agg(F.count_if(F.expr("_held and _mapped")).alias("both"), F.count_if(F.expr("_mapped is null")).alias("held"), F.count_if(F.expr("_held is null")).alias("mapped")).first()
    members = u.agg(F.sum(F.greatest(F.size("members"), F.lit(0)))).first()[0] or 0
    # as many pairs as members, and as many as mapping rows: no node of a pair stands twice, so repeats are sought among the others only
    once = seen["both"] == members - seen["held"] == mapping.count() - seen["mapped"]
    add((met.where("_mapped is null") if once else member).groupBy("node_id").count().where("count > 1"), 9, "node_id", "more than one unitig holds node")
    add((met.where("_held is null") if once else mapping).groupBy("node_id").count().where("count > 1"), 15, "node_id", "more than one mapping row for node")
    add(met.where("_held is null"), 16, "node_id", "no unitig holds mapped node")
    add(met.where("_mapped is null"), 16, "node_id", "no mapping row for node")
    placed = met.where("_held and _mapped").drop("_held", "_mapped")
    add(placed.where("owner <> unitig_id"), 17, "node_id", "mapping names another unitig for node")
    add(mapping.where("length <= 0"), 18, "node_id", "no length for node")
    add(placed.where("owner = unitig_id and ordinal <> place"), 19, "node_id", "mapping names another place for node")
    # of a unitig's members in their places the lengths, and of all of them the colours, in one pass
    fits, coloured = F.expr("owner = unitig_id and ordinal = place"), "color_ids" in mapping.columns and "color_ids" in u.columns
    sums = [F.sum(F.when(fits, F.col("length"))).alias("letters"), F.count_if(fits).alias("n"), F.min(F.when(fits, F.col("length"))).alias("least")]
    if coloured:
        sums += [F.array_sort(F.array_distinct(F.flatten(F.collect_set("color_ids")))).alias("_own"), F.count("*").alias("every")]
    total = u.withColumn("_n", F.length("sequence")).drop("sequence").join(placed.groupBy("unitig_id").agg(*sums), "unitig_id")
    shared = F.when(F.size("internal_overlaps") == joints, F.aggregate("internal_overlaps", F.lit(0).cast("long"), lambda t, x: t + x)).otherwise(joints * (k - 1 if whole_k else 0))
    wrong = F.when(F.expr("least > 0 and n = size(members)") & (F.col("letters") - shared != F.col("_n")), F.lit(True)).otherwise(False)
    total = total.withColumn("_untiled", wrong)
    if coloured:
        total = total.withColumn("_discoloured", F.expr("every = size(members)") & (F.array_sort(F.array_distinct("color_ids")) != F.col("_own")))
    total = cut(total.select("unitig_id", "_untiled", *["_discoloured"] * coloured).where("_untiled or _discoloured" if coloured else "_untiled"), "untiled")
    add(total.where("_untiled"), 20, "unitig_id", "members do not tile the sequence of unitig")
    if coloured:
        add(total.where("_discoloured"), 21, "unitig_id", "colours are not those of the members of unitig")
    for key, rows in (("unitig_id", u), ("link_id", links), ("node_id", mapping)):
        if "color_ids" in rows.columns:
            used = rows.select(key, F.explode("color_ids").alias("color_id"))
            add(used if colors is None else used.join(colors.select(F.col("color_id").cast("int").alias("color_id")), "color_id", "left_anti"), 22, key, "undefined colour on")
    return reduce(DataFrame.unionByName, out)
