"""Edits of a compacted graph: pure functions from one table bundle to the next."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import ContractError
from tessera.operators.compact import Compacted
from tessera.operators.proposals import apply_proposal


EDIT = "edit_id string, kind string, unitig_id string, other string, link_id string, cut_after int, orientation string, overlap int"


def split_unitig(c: Compacted, unitig_id: str, cut_after: int, proposal: str, edit: str) -> Compacted:
    """Cuts a unitig behind member ``cut_after``; the edge there becomes a forward link between the halves."""
    row = c.unitigs.sparkSession.createDataFrame([(edit, "split", unitig_id, None, None, cut_after, None, None)], EDIT)
    return apply_proposal(c, row, proposal, "").graph


def merge_unitigs(c: Compacted, left: str, right: str, proposal: str, edit: str) -> Compacted:
    """Joins two unitigs whose one forward link is the only one out of the first and into the second."""
    row = c.unitigs.sparkSession.createDataFrame([(edit, "merge", left, right, None, None, None, None)], EDIT)
    return apply_proposal(c, row, proposal, "").graph


def remove_edges(c: Compacted, link_ids: DataFrame) -> Compacted:
    """Without the links (link_id); ids that are no links are refused."""
    unknown = link_ids.join(c.links, "link_id", "left_anti").agg(F.min("link_id")).first()[0]
    if unknown is not None:
        raise ContractError([f"unknown link {unknown}"])
    return replace(c, links=c.links.join(link_ids, "link_id", "left_anti"))


def remove_nodes(c: Compacted, unitig_ids: DataFrame) -> Compacted:
    """Without the unitigs (unitig_id), whose links must be gone already."""
    for side in ("source", "target"):
        held = c.links.join(unitig_ids, F.col(side) == F.col("unitig_id"), "left_semi").agg(F.min("link_id")).first()[0]
        if held is not None:
            raise ContractError([f"link {held} still touches a removed unitig"])
    return replace(c, mapping=c.mapping.join(unitig_ids, "unitig_id", "left_anti"), unitigs=c.unitigs.join(unitig_ids, "unitig_id", "left_anti"))


def upsert(values: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, value) with changed and new values of ``changes`` (id, value)."""
    new = changes.select("id", F.col("value").alias("_new"), F.lit(True).alias("_set"))
    return values.join(new, "id", "full").select("id", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("value")).alias("value"))


def fresh_names(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """(id, fresh): the wanted names, and where one is in use the name with the smallest free suffix from ``_2`` on."""
    n = F.regexp_extract("id", r"_(\d+)$", 1).try_cast("int")
    suffixes = used.select(F.regexp_replace("id", r"_\d+$", "").alias("id"), n.alias("n")).where("n >= 2").groupBy("id").agg(F.collect_set("n").alias("taken"))
    rows = wanted.join(used.select("id", F.lit(True).alias("_used")).distinct(), "id", "left").join(suffixes, "id", "left")
    free = F.expr("array_min(array_except(sequence(2, size(coalesce(taken, array())) + 2), coalesce(taken, array())))")
    return rows.select("id", F.when(F.col("_used"), F.concat_ws("_", "id", free)).otherwise(F.col("id")).alias("fresh"))
