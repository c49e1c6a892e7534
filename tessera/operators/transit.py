"""Transit-style graphs: stop clusters, route colours, junction sequences."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.errors import ContractError, require_none
from tessera.functions import seq
from tessera.operators.components import connected_components, forest
from tessera.operators.ids import numbered, ranked


def cluster_stops(places: DataFrame, metres: float) -> DataFrame:
    """(stop_id, cluster_id, lat, lon): stops of one name key within ``metres``, transitively, with the cluster's mean place.

    places (stop_id, name, lat, lon). A grid over latitude turns the distance
    condition into an equi-join on name and band, so stops of one name far
    apart are never paired.
    """
    band = F.floor(F.col("lat") / F.lit(metres / 6371000.0 * 180 / math.pi)).cast("long")
    p = places.select("stop_id", seq.place_key(F.col("name")).alias("key"), "lat", "lon", band.alias("band"))
    near = p.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    a, b = p.alias("a"), near.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.stop_id") < F.col("b.stop_id"))
    close = seq.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= metres
    edges = a.join(b, same).where(close).select(F.col("a.stop_id").alias("src"), F.col("b.stop_id").alias("dst"))
    cluster = connected_components(edges)
    own = places.join(cluster, places.stop_id == cluster.node, "left").select("stop_id", F.coalesce("component", "stop_id").alias("cluster_id"), "lat", "lon")
    mean = own.groupBy("cluster_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return own.select("stop_id", "cluster_id").join(mean, "cluster_id")


def route_edges(hops: DataFrame, routes: DataFrame) -> DataFrame:
    """(source, target, route_ids): distinct directed edges with the sorted routes that use them (hops: trip_id, source, target)."""
    return hops.join(routes.select("trip_id", "route_id"), "trip_id").groupBy("source", "target").agg(F.array_sort(F.collect_set("route_id")).alias("route_ids"))


def physical_stops(visits: DataFrame, clusters: DataFrame, order: list[str]) -> DataFrame:
    """(trip_id, pos, stop_id): visits at their clusters, without repeats of the stop just left."""
    v = visits.join(clusters.select("stop_id", "cluster_id"), "stop_id").selectExpr("*", f"row_number() over (partition by trip_id order by {', '.join(order)}) as pos")
    v = v.selectExpr("trip_id", "pos", "cluster_id as stop_id", "lag(cluster_id) over (partition by trip_id order by pos) as before")
    return v.where("before is null or before <> stop_id").selectExpr("trip_id", "row_number() over (partition by trip_id order by pos) as pos", "stop_id")


def repeat_junction_sequences(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(node, sequence): a (k-1)-letter block for the junction before each node and one for that after it.

    An edge glues its source's suffix junction to its target's prefix junction;
    glued junctions share a block, numbered in order of their smallest name.
    """
    ends = nodes.select(F.explode(F.array(F.concat(F.lit("p:"), "node"), F.concat(F.lit("s:"), "node"))).alias("j"))
    glue = edges.select(F.concat(F.lit("s:"), "source").alias("src"), F.concat(F.lit("p:"), "target").alias("dst"))
    root = connected_components(forest(glue))
    named = cut(ends.join(root, ends.j == root.node, "left").select("j", F.coalesce("component", "j").alias("root")), "junctions")
    classes = cut(ranked(named.select("root").distinct(), ["root"], "number").withColumn("number", F.col("number") - 1), "classes")
    if classes.count() > 4 ** (k - 1):
        raise ContractError([f"too many junctions for k={k}"])
    block = named.join(classes, "root").select("j", seq.base4(F.col("number"), k - 1).alias("block"))
    p = block.where("j like 'p:%'").select(F.expr("substring(j, 3)").alias("node"), F.col("block").alias("head"))
    s = block.where("j like 's:%'").select(F.expr("substring(j, 3)").alias("node"), F.col("block").alias("tail"))
    return p.join(s, "node").select("node", F.concat("head", "tail").alias("sequence"))


def drawn_flows(stops: DataFrame, seed: int) -> DataFrame:
    """(route_id, flow): a normal draw for each route around its number of stops, with that number as variance, not below zero.

    stops (route_id, n). A route's draw hangs on the seed and its id alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = b.column(0).to_pylist(), b.column(1).to_pylist()
            flow = [max(0.0, float(np.random.default_rng([seed, zlib.crc32(r.encode())]).normal(m, m**0.5))) for r, m in zip(ids, n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flow, pa.float64())], names=["route_id", "flow"])

    return stops.select(F.col("route_id").cast("string"), F.col("n").cast("double")).mapInArrow(run, "route_id string, flow double")


def route_colours(routes: DataFrame, modes: list[str]) -> DataFrame:
    """(color_id, namespace, value, route_id): modes in the given order, then routes by mode, short name and id.

    A route is called by its short name; where several routes share one, the id follows it.
    """
    spark = routes.sparkSession
    own = routes.select("route_id", "mode", F.coalesce("short_name", F.lit("")).alias("short_name")).distinct()
    shared = own.groupBy("short_name").agg(F.count("*").alias("n"))
    named = own.join(shared, "short_name").withColumn("value", F.when(F.col("n") > 1, F.concat_ws(":", "short_name", "route_id")).otherwise(F.col("short_name")))
    dealt = ranked(named, ["mode", "short_name", "route_id"], "rank").select((F.col("rank") - 1 + len(modes)).cast("int").alias("color_id"), F.lit("route").alias("namespace"), "value", "route_id")
    of_mode = spark.createDataFrame([(i, "transport_type", m, None) for i, m in enumerate(modes)], "color_id int, namespace string, value string, route_id string")
    return of_mode.unionByName(dealt)


def transit_graph(stops: DataFrame, routes: DataFrame, visits: DataFrame, modes: list[str], k: int = 21, flows: DataFrame | Callable[[DataFrame], DataFrame] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and colours of a transit network.

    stops (stop_id, name[, lat, lon]), routes (route_id, mode, short_name), visits
    (trip_id, route_id, pos, stop_id). Nodes (node_id, stop_name, coverage, [lat,
    lon,] sequence, color_ids) are the visited stops; edges (edge_id, source, target,
    orientation, coverage, color_ids) distinct hops between different stops. A
    stop's coverage is the sum of its routes' flows, an edge's the mean of its ends.
    Flows (route_id, flow) may be a function of the stops that routes serve (stop_id, route_id).
    """
    # trips are put in order once; what is read again are the distinct steps
    steps = cut(visits.selectExpr("route_id", "stop_id as source", "lead(stop_id) over (partition by trip_id order by pos) as target").distinct(), "steps")
    served = cut(steps.select(F.col("source").alias("stop_id"), "route_id").distinct(), "served")
    require_none(served.join(routes, "route_id", "left_anti").select("route_id").distinct(), lambda r: f"route {r['route_id']} is not known")
    require_none(served.join(stops, "stop_id", "left_anti").select("stop_id").distinct(), lambda r: f"stop {r['stop_id']} is not known")
    hop = steps.where("target is not null and source <> target")
    flow = drawn_flows(served.groupBy("route_id").agg(F.count("*").alias("n")), seed) if flows is None else flows(served) if callable(flows) else flows
    colours = cut(route_colours(routes.join(served.select("route_id").distinct(), "route_id", "left_semi"), modes), "colours")
    of_mode = colours.where("namespace = 'transport_type'").select(F.col("value").alias("mode"), F.col("color_id").alias("_m"))
    of_route = colours.where("namespace = 'route'").select("route_id", F.col("color_id").alias("_r"))
    own = routes.select("route_id", "mode").distinct().join(of_mode, "mode").join(of_route, "route_id").select("route_id", F.array("_m", "_r").alias("c"))
    sets = lambda rows, *key: rows.join(own, "route_id").groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))).alias("color_ids"))
    coverage = cut(served.join(flow, "route_id").groupBy("stop_id").agg(F.sum("flow").alias("coverage")), "coverage")
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    pairs = hop.select("source", "target").distinct()
    sequences = repeat_junction_sequences(served.select(name("stop_id").alias("node")).distinct(), pairs.select(name("source").alias("source"), name("target").alias("target")), k)
    place = [c for c in ("lat", "lon") if c in stops.columns]
    rows = stops.join(coverage, "stop_id").join(sets(served, "stop_id"), "stop_id").select(name("stop_id").alias("node_id"), F.when(seq.tidy(F.coalesce("name", F.lit(""))) != "", seq.tidy(F.col("name"))).otherwise("unnamed").alias("stop_name"), "coverage", *place, "color_ids")
    nodes = rows.join(sequences.withColumnRenamed("node", "node_id"), "node_id")
    numbered_ = ranked(pairs.select("source", "target", name("source").alias("_s"), name("target").alias("_t")), ["_s", "_t"])
    a, b = (coverage.select(F.col("stop_id").alias(side), F.col("coverage").alias(c)) for side, c in (("source", "_a"), ("target", "_b")))
    edges = numbered_.join(a, "source").join(b, "target").join(sets(hop, "source", "target"), ["source", "target"])
    edges = edges.select(numbered("e", "rank").alias("edge_id"), F.col("_s").alias("source"), F.col("_t").alias("target"), F.lit("++").alias("orientation"), ((F.col("_a") + F.col("_b")) / 2).alias("coverage"), "color_ids")
    return nodes, edges, colours
