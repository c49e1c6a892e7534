"""Validation of dense layouts, as rows (rule, at, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _gapless(rows: DataFrame, key: str, rule: int) -> DataFrame:
    """A row where ``key`` is not 0, 1, ... without gaps and repeats; an empty table is gapless."""
    s = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.min(key).alias("low"), F.max(key).alias("high"))
    bad = s.where("n > 0 and not coalesce(d = n and low = 0 and high = n - 1, false)")
    return bad.select(F.lit(rule).alias("rule"), F.lit(key).alias("at"), F.lit(f"{key} does not run from 0 without gaps").alias("message"))


def _widths(rows: DataFrame, key: str, column: str, rule: int, bad: Column) -> DataFrame:
    """A row for each element whose array is absent, of another width than the widest, or holds a bad value."""
    widest = rows.agg(F.max(F.size(column)).alias("_widest"))  # one row
    wrong = rows.join(F.broadcast(widest)).where(F.col(column).isNull() | (F.size(column) != F.col("_widest")) | bad)
    return wrong.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("at"), F.lit(f"bad {column}").alias("message"))


def layout_violations(nodes: DataFrame, slots: DataFrame, pointers: DataFrame) -> DataFrame:
    """(rule, at, message) for nodes (dense_id, node_id[, features, colors]), slots (slot, src, dst) and pointers (dense_id, indptr).

    Ids and slots run from 0 without gaps, names are unique, slots join known
    nodes and lie between their source's pointer and its degree beyond, features
    are finite and of one width, colour masks are 0 or 1 and of one width.
    """
    degree = slots.groupBy(F.col("src").alias("dense_id")).agg(F.count("*").alias("_degree"))
    span = pointers.join(degree, "dense_id", "left").select(F.col("dense_id").alias("src"), "indptr", F.coalesce("_degree", F.lit(0)).alias("_degree"))
    misplaced = slots.join(span, "src", "left").where("indptr is null or slot < indptr or slot >= indptr + _degree")
    unpointed = nodes.join(pointers, "dense_id", "left_anti")
    twice = nodes.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1 or coalesce(node_id, '') = ''")

    def said(rows: DataFrame, rule: int, at: str, message: str) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), F.col(at).cast("string").alias("at"), F.lit(message).alias("message"))

    out = [_gapless(nodes, "dense_id", 1), said(twice, 2, "node_id", "missing or repeated node_id"), _gapless(slots, "slot", 3)]
    out += [said(slots.join(nodes.select(F.col("dense_id").alias(side)), side, "left_anti"), 4, "slot", f"unknown {side}") for side in ("src", "dst")]
    out += [said(misplaced, 5, "slot", "slot outside its source's pointers"), said(unpointed, 5, "dense_id", "no pointer")]
    if "features" in nodes.columns:
        out.append(_widths(nodes, "dense_id", "features", 6, F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))))
    if "colors" in nodes.columns:
        out.append(_widths(nodes, "dense_id", "colors", 7, F.exists("colors", lambda x: x.isNull() | ~x.isin(0, 1))))
    return reduce(DataFrame.unionByName, out)
