"""Aggregates as mergeable states.

A measure is either computed from rows at once, or kept as a state per part of a
table (a day) and finished on reading. States hold counts, extremes and the exact
pieces of sums, never averages, so a result does not depend on how the rows were
parted and equals that of the whole table in every digit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.numeric import count_where, mean, mean_of_states, sum_state, total, total_of_states


@dataclass(frozen=True)
class Measure:
    """A named aggregate: ``count`` (of rows, or of those where ``value`` holds), ``mean``, ``total``, ``min`` or ``max``."""

    name: str
    kind: str
    value: Column | None = None
    places: int = 2
    divisor: int = 1

    def of_rows(self) -> Column:
        match self.kind:
            case "count":
                column = F.count("*") if self.value is None else count_where(self.value)
            case "mean":
                column = mean(self.value, self.places)
            case "total":
                column = total(self.value, self.places, self.divisor)
            case "min" | "max":
                column = getattr(F, self.kind)(self.value)
            case _:
                raise ValueError(f"unknown kind of measure: {self.kind}")
        return column.alias(self.name)

    def state(self) -> Column:
        return sum_state(self.value).alias(self.name) if self.kind in ("mean", "total") else self.of_rows()

    def of_states(self) -> Column:
        match self.kind:
            case "count":
                column = F.sum(self.name)
            case "mean":
                column = mean_of_states(self.name, self.places)
            case "total":
                column = total_of_states(self.name, self.places, self.divisor)
            case _:
                column = getattr(F, self.kind)(self.name)
        return column.alias(self.name)


def aggregate(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """All measures per group, from rows."""
    return df.groupBy(*keys).agg(*[m.of_rows() for m in measures])


def states(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """One row per group with the state of every measure."""
    return df.groupBy(*keys).agg(*[m.state() for m in measures])


def finished(stored: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """The measures per group from states of the same or finer groups; the same as ``aggregate`` over all their rows."""
    return stored.groupBy(*keys).agg(*[m.of_states() for m in measures])
