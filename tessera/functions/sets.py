"""Colour sets: sorted arrays of distinct integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import ContractError

OPERATIONS = ("replace", "merge", "intersect", "subtract")


def combine(existing: Column, incoming: Column, operation: str) -> Column:
    """Sorted distinct result of one set operation."""
    if operation == "replace":
        out = F.array_distinct(incoming)
    elif operation == "merge":
        out = F.array_union(existing, incoming)
    elif operation == "intersect":
        out = F.array_intersect(existing, incoming)
    elif operation == "subtract":
        out = F.array_except(existing, incoming)
    else:
        raise ContractError([f"operation must be one of {', '.join(OPERATIONS)}"])
    return F.array_sort(out)


def parse(cell: Column) -> Column:
    """Array from comma-joined ids; empty for the empty cell."""
    return F.when(F.coalesce(F.trim(cell), F.lit("")) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(cell, ","), lambda x: F.trim(x).cast("int")))


def text(colors: Column) -> Column:
    return F.array_join(F.transform(colors, lambda x: x.cast("string")), ",")


def only(colors: Column, keep: Column) -> Column:
    """The members that are also in ``keep``, in their order."""
    return F.filter(colors, lambda c: F.array_contains(keep, c))
