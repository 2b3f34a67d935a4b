"""Joins to a table of keys of which a few may stand for a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than one of so many rows is heavy: there are fewer heavy keys than this.
HEAVY = 1000


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, count: str = "_n") -> DataFrame:
    """``rows`` with the columns of ``lookup``, a stored table of one row for each key that says in ``count`` how many rows have it.

    Heavy keys are broadcast and looked up where the rows are, so that they don't gather in one task; fewer than HEAVY
    rows are broadcast, whatever the size of the input. Rows whose key the lookup lacks are dropped.
    """
    most = F.lit(rows.count() / HEAVY)
    heavy = F.broadcast(lookup.where(F.col(count) > most).drop(count))
    few = rows.join(heavy.select(key), key, "left_anti").join(lookup.where(F.col(count) <= most).drop(count), key)
    return rows.join(heavy, key).unionByName(few)
