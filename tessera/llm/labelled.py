"""Labelled rows for the trained models: folds and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the doc_id written as text, modulo ``modulus``; null where the doc_id is."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % modulus


def labelled(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, y): the labelled doc_ids for which ``learn`` holds.

    Rows without a doc_id or a label are skipped; of a doc_id that is labelled
    more than once the largest label counts.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    return y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("y"))


def training_labels(labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(doc_id, y, weight): at most ``rows`` :func:`labelled` doc_ids of either label.

    Where a label has more, those with the smallest hashes stay, so the choice
    hangs on doc_ids alone; ``weight`` is how many rows of its label a row stands for.
    """
    y = labelled(labels, label, learn)
    n = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = []
    for k in (0, 1):
        some = y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        parts.append(some.withColumn("weight", F.lit(max(1.0, n.get(k, 0) / rows))))
    return parts[0].unionByName(parts[1])
