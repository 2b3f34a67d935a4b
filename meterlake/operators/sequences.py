"""Order-dependent operators: counters, carried values, and which of several rows stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.keys import is_blank
from meterlake.functions.numbers import minus, without_cache
from meterlake.operators.filters import is_system_text

COUNTERS = ("input", "output", "cache_create", "cache_read")


def counter_deltas(events: DataFrame, by: str, order: Sequence[str], total: str = "total", last: str = "last") -> DataFrame:
    """``events`` with delta: what each event adds to cumulative counters, cached tokens taken out of the input.

    ``total`` and ``last`` are structs of COUNTERS; either may be null. The baseline is the last total before the event;
    events without a total don't move it. Where any counter fell, and at the first event, ``last`` counts if there is one,
    else the total. Without a total only ``last`` counts; without either the delta is null.
    """
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_base", F.last(total, ignorenulls=True).over(before))
    t, base, own = F.col(total), F.col("_base"), F.col(last)
    fell = F.lit(False)
    for c in COUNTERS:
        fell = fell | (t[c] < base[c])
    grown = F.struct(*(minus(t[c], base[c]).alias(c) for c in COUNTERS))
    raw = F.when(t.isNull(), own).when(base.isNull() | fell, F.coalesce(own, t)).otherwise(grown)
    split = without_cache(F.col("_raw.input"), F.col("_raw.cache_read"), clamp=True)
    delta = F.struct(split["input"].alias("input"), F.col("_raw.output").alias("output"), F.col("_raw.cache_create").alias("cache_create"), split["cache_read"].alias("cache_read"))
    return rows.withColumn("_raw", raw).withColumn("delta", F.when(F.col("_raw").isNotNull(), delta)).drop("_base", "_raw")


def after_fork(deltas: DataFrame, ts: str, fork_start: str) -> DataFrame:
    """Replayed events of a forked session only move the baseline: they leave after the deltas are taken."""
    return deltas.where(F.col(fork_start).isNull() | (F.col(ts) > F.col(fork_start)))


def carried(rows: DataFrame, column: str, by: str, order: Sequence[str], otherwise: str = "unknown") -> DataFrame:
    """``column`` with blanks filled from the last row of the group that had a value."""
    seen = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(~is_blank(F.col(column)), F.col(column))
    return rows.withColumn(column, F.coalesce(F.last(own, ignorenulls=True).over(seen), F.lit(otherwise)))


def numbered(rows: DataFrame, by: str, order: Sequence[str], name: str = "event_index") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def keep_first(rows: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def keep_largest(rows: DataFrame, by: Sequence[str], size: str = "total_tokens", ts: str = "timestamp", *ties: str) -> DataFrame:
    """Of several versions of a message the largest stays, of equal ones the newest."""
    return keep_first(rows, by, F.desc(size), F.desc(ts), *(F.col(t) for t in ties))


def first_owner(messages: DataFrame, source_rank: str = "source_rank", modified: str = "last_modified") -> DataFrame:
    """Each message belongs to the oldest session that has it; a copy in a fork goes. Blank ids are all kept."""
    blank = is_blank(F.col("message_id"))
    order = Window.partitionBy("message_id").orderBy(source_rank, modified, "session_id")
    return messages.withColumn("_n", F.when(blank, 1).otherwise(F.row_number().over(order))).where("_n = 1").drop("_n")


def message_keys(messages: DataFrame) -> DataFrame:
    """``messages`` with key: the message id, with its session where several sessions use the id."""
    shared = messages.groupBy("message_id").agg(F.count_distinct("session_id").alias("_sessions"))
    return messages.join(shared, "message_id").withColumn("key", F.when(F.col("_sessions") > 1, F.concat_ws(":", "session_id", "message_id")).otherwise(F.col("message_id"))).drop("_sessions")


def id_conflicts(messages: DataFrame, limit: int = 100) -> DataFrame:
    """Ids that several sessions use."""
    return messages.where(~is_blank(F.col("message_id"))).groupBy("message_id").agg(F.count_distinct("session_id").alias("sessions")).where("sessions > 1").orderBy(F.desc("sessions"), "message_id").limit(limit)


def topic_and_last_prompt(turns: DataFrame, by: str, ts: str, text: str, is_user: Column) -> DataFrame:
    """First and last text of each session that the user wrote: what a tool writes in the user's name doesn't count."""
    own = F.when(is_user & ~is_system_text(F.col(text)), F.struct(ts, text))
    return turns.groupBy(by).agg(F.min(own)[text].alias("topic"), F.max(own)[text].alias("last_prompt"))


def without_fork_replays(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages that are not older than their session; a session that is unknown, or has no start, drops none."""
    start = sessions.select("session_id", F.col("time_created").alias("_start"))
    return messages.join(start, "session_id", "left").where(F.col("_start").isNull() | (F.col("time_created") >= F.col("_start"))).drop("_start")
