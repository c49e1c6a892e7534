"""Validation failures that carry every message found."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row


class ContractError(ValueError):
    """All violations of one check, in the order in which they were found."""

    def __init__(self, errors: Iterable[str]) -> None:
        self.errors = list(errors)
        super().__init__("; ".join(self.errors))


def gathered(rows: DataFrame, message: Callable[[Row], str], most: int = 1000) -> list[str]:
    """A message for each row, in ascending order of the columns; beyond ``most`` the number of the others ends the list."""
    found = rows.orderBy(*rows.columns).limit(most + 1).collect()
    if len(found) <= most:
        return [message(r) for r in found]
    return [message(r) for r in found[:most]] + [f"and {rows.count() - most} more"]


def require_none(rows: DataFrame, message: Callable[[Row], str], most: int = 1000) -> None:
    """Raises with the messages of :func:`gathered` where there are rows."""
    if errors := gathered(rows, message, most):
        raise ContractError(errors)
