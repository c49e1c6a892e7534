"""Aggregation of member annotations into one value a group, by named policy."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.errors import ContractError, gathered, require_none

NUMERIC = ("mean", "sum", "min", "max", "median", "weighted_mean")
POLICIES = (*NUMERIC, "union", "majority", "keep_per_member")


def check_policy(policy: str, dtype: str, vector: bool = False) -> None:
    if policy not in POLICIES:
        raise ContractError([f"{policy} is none of the policies {', '.join(POLICIES)}"])
    if policy in NUMERIC and dtype == "category":
        raise ContractError([f"{policy} needs a numeric layer"])
    if policy in ("union", "majority") and (vector or dtype == "float64"):
        raise ContractError([f"{policy} needs a scalar int64 or category layer"])


def aggregate(members: DataFrame, values: DataFrame, policy: str, dtype: str = "float64", weights: DataFrame | None = None) -> DataFrame:
    """(group, value) from members (group, id) and values (id, value).

    Every member needs a value. ``weighted_mean`` needs weights (id, weight),
    all positive and finite; ``majority`` needs one most frequent value in each
    group; ``keep_per_member`` gives every member's value.
    """
    check_policy(policy, dtype)
    rows = members.join(values, "id", "left")
    missing = rows.where("value is null").agg(F.min("id")).first()[0]
    if missing is not None:
        raise ContractError([f"no value for member {missing}"])
    g, v = rows.groupBy("group"), F.col("value")
    if policy == "mean":
        return g.agg(F.avg(v.cast("double")).alias("value"))
    if policy in ("sum", "min", "max", "median"):
        return g.agg(getattr(F, policy)(v).alias("value"))
    if policy == "weighted_mean":
        if weights is None:
            raise ContractError(["weighted_mean needs weights"])
        w = rows.join(weights, "id", "left")
        weight = F.col("weight").cast("double")
        sound = F.coalesce((weight > 0) & (weight < float("inf")) & ~F.isnan(weight), F.lit(False))
        require_none(w.where(~sound).select("id"), lambda r: f"member {r['id']} has no weight above 0")
        return w.groupBy("group").agg((F.sum(F.col("weight") * v) / F.sum("weight")).alias("value"))
    if policy == "union":
        return g.agg(F.array_join(F.array_sort(F.collect_set(v.cast("string"))), "|").alias("value"))
    if policy == "majority":
        n = rows.groupBy("group", "value").agg(F.count("*").alias("n"))
        top = n.withColumn("r", F.rank().over(Window.partitionBy("group").orderBy(F.desc("n")))).where("r = 1")
        tied = top.groupBy("group").count().where("count > 1").agg(F.min("group")).first()[0]
        if tied is not None:
            raise ContractError([f"no unique majority in {tied}"])
        return top.select("group", "value")
    return rows.select("group", "value")


def most_frequent(rows: DataFrame) -> DataFrame:
    """(group, value): the most frequent value, the smallest of equals, for rows (group, value)."""
    n = rows.groupBy("group", "value").agg(F.count("*").alias("n"))
    return n.groupBy("group").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def transfer(rows: DataFrame, key: str, columns: list[str], targets: DataFrame) -> DataFrame:
    """(id, feature, value): declared columns of original rows as a long layer for the elements of a compacted graph.

    ``targets`` (id) must name exactly the rows' keys, and no cell may be blank.
    """
    lost = rows.select(F.col(key).alias("id")).join(targets, "id", "left_anti").agg(F.min("id")).first()[0]
    extra = targets.join(rows.select(F.col(key).alias("id")), "id", "left_anti").agg(F.min("id")).first()[0]
    errors = ([f"{lost} is not in the compacted graph"] if lost is not None else []) + ([f"{extra} has no row"] if extra is not None else [])
    long = rows.select(F.col(key).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")).select("id", "v.*")
    blank = long.where("value is null or trim(value) = ''").agg(F.min(F.struct("id", "feature"))).first()[0]
    if blank is not None:
        errors.append(f"blank cell {blank['feature']} of {blank['id']}")
    if errors:
        raise ContractError(errors)
    return long


# Fields, target types, value types and the pattern of names that layers of other tools have.
PROVENANCE = ("source", "method", "version", "parameters", "parent_graph_id", "parent_schema_version", "parent_contract_version")
TARGETS = ("node", "internal_node", "edge", "internal_edge")
DTYPES = ("float64", "int64", "category")
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.-]*")


@dataclass(frozen=True)
class Layers:
    """Annotation layers: ``about`` has a row for each layer, ``values`` one for each annotated element.

    A float64 number or vector stands in ``numbers``, an int64 one in ``whole``,
    and a category in ``category``.
    """

    ABOUT: ClassVar[str] = "namespace string, feature string, target_type string, dtype string, kind string, aggregation string, provenance map<string,string>"
    VALUES: ClassVar[str] = "target_id string, numbers array<double>, whole array<long>, category string, namespace string, feature string, target_type string"
    ABOUT_COLUMNS: ClassVar[tuple[str, ...]] = ("namespace", "feature", "target_type", "dtype", "kind", "aggregation", "provenance")
    VALUE_COLUMNS: ClassVar[tuple[str, ...]] = ("target_id", "numbers", "whole", "category", "namespace", "feature", "target_type")

    about: DataFrame
    values: DataFrame

    @staticmethod
    def none(spark: SparkSession) -> Layers:
        return Layers(spark.createDataFrame([], Layers.ABOUT), spark.createDataFrame([], Layers.VALUES))


def provenance_errors(provenance: dict, graph: dict | None = None) -> list[str]:
    """What is wrong with a layer's provenance: lacking, empty or unknown fields, or another parent than the graph with these metadata."""
    errors = [f"provenance lacks {f}" for f in PROVENANCE if f not in provenance]
    errors += [f"provenance has no field {f}" for f in sorted(set(provenance) - set(PROVENANCE))]
    errors += [f"the field {f} of provenance is empty or no text" for f in PROVENANCE if f in provenance and f != "parameters" and not (isinstance(provenance[f], str) and provenance[f])]
    for name in ("graph_id", "schema_version", "contract_version") if graph is not None else ():
        if (said := provenance.get(f"parent_{name}")) is not None and said != graph.get(name):
            errors.append(f"the parent's {name} is {graph.get(name)} and not {said}")
    return errors


def _of(rows: DataFrame, key: tuple[str, str, str]) -> Column:
    return (F.col("namespace") == key[0]) & (F.col("feature") == key[1]) & (F.col("target_type") == key[2])


def attach(layers: Layers, rows: DataFrame, targets: DataFrame, key: tuple[str, str, str], dtype: str, provenance: dict, kind: str = "scalar", replace: bool = False, aggregation: str | None = None, graph: dict | None = None) -> Layers:
    """Layers with one more: ``rows`` (target_id, value) under ``key`` (namespace, feature, target_type).

    Every target must be one of ``targets`` (target_id), be named once and have a
    value of the declared type; vectors are arrays of one width, and float64
    values are finite. With the metadata of the ``graph`` the provenance must name
    it as parent. A key in use is an error unless it is to be replaced. All
    errors are raised together.
    """
    errors = [f"{what} {v!r} is no safe name" for what, v in (("namespace", key[0]), ("feature", key[1])) if not NAME.fullmatch(v)]
    errors += [f"target type {key[2]} is none of {', '.join(TARGETS)}"] if key[2] not in TARGETS else []
    if dtype not in DTYPES or kind not in ("scalar", "vector") or (kind == "vector" and dtype == "category"):
        errors.append(f"{kind} layers of {dtype} are not supported")
    errors += provenance_errors(provenance, graph)
    if not replace and not layers.about.where(_of(layers.about, key)).isEmpty():
        errors.append(f"layer {':'.join(key)} exists already")
    if errors:
        raise ContractError(errors)
    met = rows.select("target_id", F.lit(1).alias("n"), F.lit(0).alias("known")).unionByName(targets.select("target_id", F.lit(0).alias("n"), F.lit(1).alias("known")))
    odd = cut(met.groupBy("target_id").agg(F.sum("n").alias("n"), F.max("known").alias("known")).where("n > 1 or n = 1 and known = 0"), "odd-targets")
    errors = gathered(odd.where("known = 0").select("target_id"), lambda r: f"{r['target_id']} is no {key[2]} of the graph")
    errors += gathered(odd.where("n > 1").select("target_id", "n"), lambda r: f"{r['target_id']} has {r['n']} values")
    typed = rows.schema["value"].dataType.simpleString()
    if dtype == "int64" and re.search("double|float|decimal", typed):
        raise ContractError([*errors, f"int64 layers hold whole numbers, not {typed}"])
    text = F.col("value").cast("string")

    def number(x: Column) -> Column:
        return x.cast("string").try_cast("double" if dtype == "float64" else "long")

    def unsound(x: Column) -> Column:
        return number(x).isNull() | F.isnan(number(x).cast("double")) | (F.abs(number(x).cast("double")) == float("inf"))

    if kind == "vector":
        width = rows.agg(F.max(F.size("value"))).first()[0]
        bad = F.col("value").isNull() | (F.size("value") != F.lit(width)) | (F.size("value") < 1) | F.exists("value", unsound)
    elif dtype == "category":
        bad = F.coalesce(F.trim(text), F.lit("")) == ""
    else:
        bad = unsound(F.col("value"))
    errors += gathered(rows.where(bad).select("target_id"), lambda r: f"{r['target_id']} has no value of type {dtype}")
    if errors:
        raise ContractError(errors)
    values = F.lit(None) if dtype == "category" else F.transform("value", number) if kind == "vector" else F.array(number(F.col("value")))
    of = lambda name: values if dtype == name else F.lit(None)
    new = rows.select("target_id", of("float64").cast("array<double>").alias("numbers"), of("int64").cast("array<long>").alias("whole"), (text if dtype == "category" else F.lit(None).cast("string")).alias("category"), *[F.lit(v).alias(n) for n, v in zip(("namespace", "feature", "target_type"), key, strict=True)])
    spark = rows.sparkSession
    entry = spark.createDataFrame([(*key, dtype, kind, aggregation, {k: str(v) for k, v in provenance.items()})], Layers.ABOUT)
    return Layers(layers.about.where(~_of(layers.about, key)).unionByName(entry), layers.values.where(~_of(layers.values, key)).unionByName(new))


def layer(layers: Layers, key: tuple[str, str, str]) -> DataFrame:
    """(target_id, numbers, whole, category) of the layer with that key."""
    if layers.about.where(_of(layers.about, key)).isEmpty():
        raise ContractError([f"there is no layer {':'.join(key)}"])
    return layers.values.where(_of(layers.values, key)).select("target_id", "numbers", "whole", "category")


def feature_block(layers: Layers, names: Sequence[tuple[str, str]], keys: DataFrame, target_type: str) -> tuple[DataFrame, list[str]]:
    """(target_id, features) of the named numeric layers side by side for every key (target_id), and a name for each place.

    A vector's places are ``namespace:feature:0`` and so on. Categories and edges
    inside unitigs are refused, and every key needs a value in every layer.
    """
    if target_type == "internal_edge":
        raise ContractError(["edges inside unitigs have no row in a dense layout"])
    out, places = keys.select("target_id").withColumn("features", F.array().cast("array<float>")), []
    for namespace, feature in names:
        key = (namespace, feature, target_type)
        rows = layer(layers, key)
        if rows.where("category is not null").limit(1).count():
            raise ContractError([f"layer {':'.join(key)} holds categories"])
        require_none(keys.join(rows, "target_id", "left_anti").select("target_id"), lambda r, key=key: f"{r['target_id']} has no value in {':'.join(key)}")
        rows = rows.select("target_id", F.coalesce("numbers", F.col("whole").cast("array<double>")).alias("numbers"))
        width = rows.agg(F.max(F.size("numbers"))).first()[0] or 0
        scalar = layers.about.where(_of(layers.about, key)).first()["kind"] == "scalar"
        places += [f"{namespace}:{feature}"] if scalar else [f"{namespace}:{feature}:{i}" for i in range(width)]
        out = out.join(rows.select("target_id", "numbers"), "target_id").select("target_id", F.concat("features", F.col("numbers").cast("array<float>")).alias("features"))
    return out, places


def reassigned(values: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, value): a categorical layer with the values of ``changes``, which may only name rows that are there."""
    require_none(changes.join(values, "id", "left_anti").select("id"), lambda r: f"{r['id']} has no label to reassign")
    new = changes.select("id", F.col("value").alias("_new"))
    return values.join(new, "id", "left").select("id", F.coalesce("_new", "value").alias("value"))


def marked(flags: DataFrame, ids: DataFrame, known: DataFrame) -> DataFrame:
    """(id, value): the layer of suspicious elements with a 1 for each of ``ids``, which must be ``known``."""
    require_none(ids.join(known, "id", "left_anti").select("id"), lambda r: f"{r['id']} is no element of the graph")
    return flags.select("id", F.col("value").cast("long").alias("value")).join(ids, "id", "left_anti").unionByName(ids.select("id").distinct().withColumn("value", F.lit(1).cast("long")))


def aggregate_layer(layers: Layers, key: tuple[str, str, str], members: DataFrame, target_type: str, policy: str, provenance: dict, weights: DataFrame | None = None, graph: dict | None = None, feature: str | None = None) -> Layers:
    """Layers with one more: the layer ``key`` of members (group, id) brought to their groups, with the policy on record.

    The new layer has the namespace of the old one and the name ``feature``, or
    the old name and the policy. ``keep_per_member`` keeps the members' own
    values and target type.
    """
    about = layers.about.where(_of(layers.about, key)).first()
    if about is None:
        raise ContractError([f"there is no layer {':'.join(key)}"])
    check_policy(policy, about["dtype"], about["kind"] == "vector")
    if about["kind"] == "vector" and policy != "keep_per_member":
        raise ContractError([f"{policy} of a vector layer is not supported"])
    own = {"float64": "numbers", "int64": "whole"}.get(about["dtype"])
    value = F.col("category") if own is None else F.col(own) if about["kind"] == "vector" else F.col(own)[0]
    rows = layer(layers, key).select(F.col("target_id").alias("id"), value.alias("value"))
    name = feature or f"{key[1]}.{policy}"
    if policy == "keep_per_member":
        require_none(members.join(rows, "id", "left_anti").select("id"), lambda r: f"no value for member {r['id']}")
        kept = rows.join(members.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("target_id"), "value")
        return attach(layers, kept, members.select(F.col("id").alias("target_id")).distinct(), (key[0], name, key[2]), about["dtype"], provenance, about["kind"], aggregation=policy, graph=graph)
    made = aggregate(members, rows, policy, about["dtype"], weights).withColumnRenamed("group", "target_id")
    whole = about["dtype"] == "int64" and policy in ("sum", "min", "max", "majority")
    dtype = "category" if policy == "union" or about["dtype"] == "category" else "int64" if whole else "float64"
    return attach(layers, made, members.select(F.col("group").alias("target_id")).distinct(), (key[0], name, target_type), dtype, provenance, aggregation=policy, graph=graph)


def transfer_layers(layers: Layers, nodes: DataFrame, edges: DataFrame, members: DataFrame, links: DataFrame, internal: DataFrame, columns: dict[str, dict[str, str]], namespace: str, provenance: dict, graph: dict | None = None) -> Layers:
    """Layers with the declared columns of an original graph's nodes (node_id, ...) and edges (edge_id, ...).

    ``columns`` gives the value types of the columns of ``node`` and ``edge``. Node
    columns become layers of the members (node_id); an edge column becomes a
    layer of the links (link_id) and one of the edges inside unitigs (edge_id), of
    which an empty one is left out. Both tables must name exactly what the
    compacted graph has, and no cell may be blank.
    """
    if not any(columns.get(kind) for kind in ("node", "edge")):
        raise ContractError(["no column is to be transferred"])
    ids = members.select(F.col("node_id").alias("id"))
    outer, inner = links.select(F.col("link_id").alias("id")), internal.select(F.col("edge_id").alias("id"))
    both = gathered(outer.join(inner, "id", "left_semi"), lambda r: f"edge {r['id']} is a link and inside a unitig")
    if both:
        raise ContractError(both)
    moved = []
    if columns.get("node"):
        moved.append((transfer(nodes, "node_id", list(columns["node"]), ids), ids, "internal_node", columns["node"]))
    if columns.get("edge"):
        long = transfer(edges, "edge_id", list(columns["edge"]), outer.unionByName(inner))
        moved += [(long.join(part, "id", "left_semi"), part, kind, columns["edge"]) for part, kind in ((inner, "internal_edge"), (outer, "edge")) if not part.isEmpty()]
    for long, targets, kind, types in moved:
        for name, dtype in types.items():
            rows = long.where(F.col("feature") == name).select(F.col("id").alias("target_id"), "value")
            layers = attach(layers, rows, targets.select(F.col("id").alias("target_id")), (namespace, name, kind), dtype, provenance, graph=graph)
    return layers
