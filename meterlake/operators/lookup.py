"""Few facts out of many rows: the keys that can matter are found first, and only what any side has of them is merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.calendar import HOUR
from meterlake.functions.keys import is_blank
from meterlake.operators.merge import keyed_local, keyed_proxy, merge_facts, with_messages

_SPANS = (HOUR, 8 * HOUR, 64 * HOUR, 512 * HOUR, 4096 * HOUR)


def facts_of_keys(keys: DataFrame, proxy: DataFrame, local: DataFrame, remote: DataFrame | None = None, **options) -> DataFrame:
    """Facts of some keys (k), as ``merge_facts`` of everything has them; ``options`` are its own.

    Rows of other keys leave before anything is shuffled for the merge, wherever the keys are few enough to be broadcast.
    """
    keys = keys.select("k").distinct()
    own = keyed_proxy(proxy).join(keys, "k", "left_semi").drop("k")
    ours = keyed_local(local).join(keys, "k", "left_semi").drop("k")
    theirs = None if remote is None else keyed_local(remote).join(keys, "k", "left_semi").drop("k")
    # a message may name its session in a row of another key
    unnamed = own.where(is_blank(F.col("session_id")) & ~is_blank(F.col("message_id")))
    messages = with_messages(local.select("message_id", "session_id", "timestamp"), unnamed)
    return merge_facts(own, ours, theirs, messages=messages, **options)


def keys_of_session(session_id: str, proxy: DataFrame, local: DataFrame, remote: DataFrame | None = None) -> DataFrame:
    """The keys (k) whose fact may belong to a session: some row of theirs names it, or has a message that does."""
    one, none = F.col("session_id") == session_id, is_blank(F.col("session_id"))
    mine = keyed_local(local).where(one)
    found = mine.select("k")
    if remote is not None:
        found = found.unionByName(keyed_local(remote).where(one).select("k"))
    told = mine.where(~is_blank(F.col("message_id"))).select("message_id", F.lit(True).alias("_told")).distinct()
    seen = keyed_proxy(proxy).where(one | none).join(told, "message_id", "left")
    return found.unionByName(seen.where(one | F.col("_told")).select("k"))


def session_facts(session_id: str, proxy: DataFrame, local: DataFrame, remote: DataFrame | None = None, **options) -> DataFrame:
    """The facts of one session."""
    keys = keys_of_session(session_id, proxy, local, remote)
    return facts_of_keys(keys, proxy, local, remote, **options).where(F.col("session_id") == session_id)


def facts_since(seconds: int, proxy: DataFrame, local: DataFrame, remote: DataFrame | None = None, **options) -> DataFrame:
    """The facts whose time in milliseconds is that of a second or later: a fact has the time of one of its rows."""
    keys = keyed_proxy(proxy.where(F.col("timestamp") >= seconds * 1000)).select("k")
    for rows in (local, remote):
        if rows is not None:
            keys = keys.unionByName(keyed_local(rows.where(F.col("timestamp") >= seconds)).select("k"))
    return facts_of_keys(keys, proxy, local, remote, **options).where(F.col("timestamp_ms") >= seconds * 1000)


def _stretches(count: int, proxy: DataFrame, local: DataFrame, remote: DataFrame | None) -> list[int]:
    """Seconds since which there are rows enough for ``count`` facts, the latest first; from times alone, counted in one pass."""
    times = proxy.select(F.expr("timestamp div 1000").alias("at"))
    for rows in (local, remote):
        if rows is not None:
            times = times.unionByName(rows.select(F.col("timestamp").alias("at")))
    last = times.agg(F.max("at")).first()[0]
    if last is None:
        return []
    # a fact has at least one row, and seldom more than one on each side
    found = times.agg(*(F.count_if(F.col("at") >= last - span).alias(f"n{span}") for span in _SPANS)).first()
    return [last - span for span in _SPANS if found[f"n{span}"] >= 4 * count]


def newest_facts(count: int, chosen: Callable[[DataFrame], DataFrame], proxy: DataFrame, local: DataFrame, remote: DataFrame | None = None, **options) -> DataFrame:
    """The ``count`` newest facts (by timestamp_ms) that ``chosen`` keeps, the newest first; a page, which the driver holds.

    They are looked for in a stretch of time up to the last row, and in one eight times as long if that holds too few; at last
    in all facts.
    """
    for since in _stretches(count, proxy, local, remote):
        page = newest(chosen(facts_since(since, proxy, local, remote, **options)), count)
        rows = page.collect()
        if len(rows) == count:
            return proxy.sparkSession.createDataFrame(rows, page.schema)
    return newest(chosen(merge_facts(proxy, local, remote, **options)), count)


def newest(facts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of facts from the newest on; of equal times the smaller key comes first."""
    return facts.orderBy(F.desc_nulls_last("timestamp_ms"), "canonical_request_key").offset(offset).limit(limit)
