"""How long the current five-hour block will last: anchored blocks, burn rate and the usual pace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_SECONDS, SAMPLE_SECONDS, LOOKBACK_SECONDS, LEAST_ACTIVE_HOURS = 5 * 3600, 90 * 60, 7 * 86_400, 3


def block_start(times: Column) -> Column:
    """Start of the last block of sorted times: a time opens a block five hours after the last opened, or after a gap of five hours."""

    def step(acc: Column, t: Column) -> Column:
        opens = acc["start"].isNull() | (t - acc["start"] >= BLOCK_SECONDS) | (t - acc["prev"] >= BLOCK_SECONDS)
        return F.struct(F.when(opens, t).otherwise(acc["start"]).alias("start"), t.alias("prev"))

    none = F.lit(None).cast("long")
    return F.aggregate(times, F.struct(none.alias("start"), none.alias("prev")), step, lambda a: a["start"])


def current_blocks(facts: DataFrame, as_of: int, *by: str, start: int | None = None) -> DataFrame:
    """The open block of each group, from facts since ``start`` (seven days back unless said otherwise); none if it ran out.

    Where blocks are anchored depends on where the facts begin. Only distinct seconds are gathered, at most one for each second
    of the range, so that a group's array is bounded by the range, however many facts it has.
    """
    since = as_of - LOOKBACK_SECONDS if start is None else start
    recent = facts.where((F.col("timestamp_sec") >= since) & (F.col("timestamp_sec") <= as_of))
    keys = list(by) or ["_all"]
    grouped = recent.withColumn("_all", F.lit(1)).groupBy(*keys, "timestamp_sec").agg(F.sum("total_tokens").alias("tokens"), F.count("*").alias("n"))
    item = F.struct("timestamp_sec", "tokens", "n")
    listed = grouped.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("start_epoch", block_start(F.transform("items", lambda x: x["timestamp_sec"])))
    own = F.filter("items", lambda x: x["timestamp_sec"] >= F.col("start_epoch"))
    ends = F.col("start_epoch") + BLOCK_SECONDS
    zero = F.lit(0).cast("long")
    return listed.where(ends > as_of).select(
        *by,
        "start_epoch",
        ends.alias("resets_at_epoch"),
        F.aggregate(own, zero, lambda a, x: a + x["tokens"]).alias("used_tokens"),
        F.aggregate(own, zero, lambda a, x: a + x["n"]).alias("used_requests"),
        (F.lit(as_of) - F.col("start_epoch")).alias("elapsed_seconds"),
        (ends - as_of).alias("remaining_seconds"),
    )


def burn_rate(facts: DataFrame, as_of: int) -> DataFrame:
    """One row: tokens and requests an hour over the last 90 minutes, from the first request in them on."""
    s = facts.where((F.col("timestamp_sec") >= as_of - SAMPLE_SECONDS) & (F.col("timestamp_sec") <= as_of)).agg(F.count("*").alias("sample_requests"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("_tokens"), F.min("timestamp_sec").alias("_first"))
    span = F.when(F.col("sample_requests") > 0, F.greatest(F.lit(as_of) - F.col("_first"), F.lit(1))).otherwise(0)
    n, hours = F.col("sample_requests"), F.col("sample_seconds") / 3600.0
    s = s.withColumn("sample_seconds", span)
    return s.select(
        F.coalesce(F.try_divide(F.col("_tokens").cast("double"), hours), F.lit(0.0)).alias("tokens_per_hour"),
        F.coalesce(F.try_divide(n.cast("double"), hours), F.lit(0.0)).alias("requests_per_hour"),
        "sample_seconds",
        "sample_requests",
        F.when((n >= 8) & (F.col("sample_seconds") >= 1800), "high").when(n >= 3, "medium").otherwise("low").alias("confidence"),
    )


def baseline(facts: DataFrame, as_of: int) -> DataFrame:
    """Mean tokens of the hours of the last seven days that used any; no row with fewer than three such hours."""
    hours = facts.where((F.col("timestamp_sec") >= as_of - LOOKBACK_SECONDS) & (F.col("timestamp_sec") <= as_of)).groupBy(F.floor(F.col("timestamp_sec") / 3600).alias("h")).agg(F.sum("total_tokens").alias("t")).where("t > 0")
    return hours.agg(F.count("*").alias("active_hours"), F.avg("t").alias("avg_tokens_per_hour")).where(F.col("active_hours") >= LEAST_ACTIVE_HOURS)


def survival(facts: DataFrame, as_of: int) -> DataFrame:
    """One row of everything; parts that can't be told are null."""
    key = F.lit(1).alias("_one")
    burn, base, block = burn_rate(facts, as_of).select("*", key), baseline(facts, as_of).select("*", key), current_blocks(facts, as_of).select("*", key)
    out = burn.join(base, "_one", "left").join(block, "_one", "left")
    pace = F.when((F.col("avg_tokens_per_hour") > 0) & (F.col("tokens_per_hour") > 0), F.col("tokens_per_hour") / F.col("avg_tokens_per_hour"))
    ahead = F.floor(F.greatest(F.col("tokens_per_hour") * (F.col("remaining_seconds") / 3600.0), F.lit(0.0)))
    return out.select(
        F.when(F.col("active_hours").isNotNull(), "baseline").otherwise("none").alias("source_kind"),
        "tokens_per_hour", "requests_per_hour", "sample_seconds", "sample_requests", "confidence", "avg_tokens_per_hour", pace.alias("relative_to_baseline"),
        "start_epoch", "resets_at_epoch", "used_tokens", "used_requests", "elapsed_seconds", "remaining_seconds", (F.col("used_tokens") + ahead).alias("projected_end_tokens"),
    )
