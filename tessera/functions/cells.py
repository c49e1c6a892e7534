"""Nested cells of text tables: lists joined by commas, and groups of them by bars, '-' for the empty group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def names(cell: Column) -> Column:
    """Array of the comma-joined texts; empty for the empty cell."""
    return F.when(F.coalesce(cell, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(cell, ","))


def numbers(cell: Column) -> Column:
    """Array of comma-joined integers; anything else in the list is an error of the cast."""
    return F.transform(names(cell), lambda x: F.trim(x).cast("int"))


def groups(cell: Column) -> Column:
    """Array of integer arrays."""
    parts = F.when(F.coalesce(cell, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(cell, r"\|"))
    return F.transform(parts, lambda p: F.when(p == "-", F.array().cast("array<int>")).otherwise(F.transform(F.split(p, ","), lambda x: F.trim(x).cast("int"))))


def joined(values: Column) -> Column:
    """The comma-joined cell of an array; a null array is the empty cell."""
    return F.coalesce(F.array_join(values.cast("array<string>"), ","), F.lit(""))


def joined_groups(values: Column) -> Column:
    cell = F.transform(values, lambda g: F.when(F.size(g) > 0, F.array_join(g.cast("array<string>"), ",")).otherwise("-"))
    return F.coalesce(F.array_join(cell, "|"), F.lit(""))
