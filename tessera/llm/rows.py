"""What tells the rows of a documents table apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(docs: DataFrame, *without: str) -> DataFrame:
    """``docs`` as (doc, mark, doc_id, text, row): ``row`` holds all columns but those ``without``, whatever their names.

    ``doc`` and ``mark`` are alike where doc_id and text are: ``mark`` hashes the
    text and whether the doc_id is null, so rows without a doc_id and rows that
    share one are documents of their own, and only copies are taken together.
    """
    doc = F.col("doc_id").cast("long")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without])
    return docs.select(F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(doc.isNull(), "text").alias("mark"), doc.alias("doc_id"), "text", rest.alias("row"))


def unpacked(rows: DataFrame, columns: list[str], *beside: str) -> DataFrame:
    """The given columns out of ``row``, but those that stand ``beside`` it."""
    return rows.select(*[F.col(c) if c in beside else F.col("row").getField(c).alias(c) for c in columns])


def packed(docs: DataFrame, *beside: str) -> DataFrame:
    """``docs`` as one column ``row`` of all columns, whatever their names, and the columns ``beside`` it that there are."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(c) for c in beside if c in docs.columns])
