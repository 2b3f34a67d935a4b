"""Stored frames change with the library. Steps bring what an older version wrote into the shape that is written now, as it is read."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """One change of a table's shape; ``number`` is that of the shape that it leads to. Shapes before the first step have number 0."""

    number: int
    change: Callable[[DataFrame], DataFrame]


def renamed(number: int, old: str, new: str) -> Step:
    return Step(number, lambda rows: rows.withColumnRenamed(old, new))


def retyped(number: int, column: str, kind: str) -> Step:
    """Another type; what can't be read as one becomes null."""
    return Step(number, lambda rows: rows.withColumn(column, F.col(column).try_cast(kind)))


def added(number: int, column: str, kind: str, default: object = None) -> Step:
    """A new column, which older rows have the default of."""
    return Step(number, lambda rows: rows.withColumn(column, F.lit(default).cast(kind)))


def dropped(number: int, column: str) -> Step:
    return Step(number, lambda rows: rows.drop(column))


Migrations = Mapping[str, Sequence[Step]]


def shape_number(migrations: Migrations) -> int:
    """The number of the shape that is written now, over all tables."""
    return max((s.number for steps in migrations.values() for s in steps), default=0)


def migrated(rows: DataFrame, steps: Sequence[Step], number: int) -> DataFrame:
    """Rows of a shape in today's: the steps behind its number, in order. They are projections, so that filters and pruning reach the files."""
    for step in sorted(steps, key=lambda s: s.number):
        if step.number > number:
            rows = step.change(rows)
    return rows
