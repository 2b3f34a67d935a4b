"""Events of model responses folded into one usage record for each request.

Counts in events are cumulative, so that the last one of each kind counts. The fold is one aggregate, the same for a batch of
complete requests and for a stream that updates each request as its events arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meterlake.functions.numbers import first_number, rate_per_second, without_cache

#: (request_id, seq, ts_ms, data): one server-sent event each; data is its JSON.
EVENTS = "request_id string, seq long, ts_ms long, data string"
_COUNTS = ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")


def _json(path: str) -> Column:
    return F.get_json_object("data", path)


def _last(value: Column) -> Column:
    """The value of the latest event that has one."""
    return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))


def _usage(*paths: str) -> Column:
    return first_number(F.col("data"), paths)


def folded(events: DataFrame, *by: str | Column) -> DataFrame:
    """Usage of each request: ids and model from the opening event, counts from the last usage, time to the first token.

    Three dialects: message_start / content_block_delta / message_delta; chunks with choices and a final usage, at the top or in
    ``response``; and usageMetadata with candidates. Chunks whose usage is null change nothing.
    """
    kind = _json("$.type")
    content = kind.isin("content_block_delta", "response.output_text.delta") | _json("$.choices[0].delta.content").isNotNull() | _json("$.candidates[0].content.parts[0].text").isNotNull()
    # the dialects that count cached tokens into the input
    in_input = _usage("$.usage.prompt_tokens", "$.response.usage.input_tokens", "$.usageMetadata.promptTokenCount")
    cached = _usage("$.usage.prompt_tokens_details.cached_tokens", "$.response.usage.input_tokens_details.cached_tokens", "$.usageMetadata.cachedContentTokenCount")
    thoughts = F.coalesce(_usage("$.usageMetadata.thoughtsTokenCount"), F.lit(0))
    output = F.coalesce(_usage("$.message.usage.output_tokens", "$.usage.output_tokens", "$.usage.completion_tokens", "$.response.usage.output_tokens"), _usage("$.usageMetadata.candidatesTokenCount") + thoughts)
    out = events.groupBy("request_id", *by).agg(
        _last(F.coalesce(_json("$.message.id"), _json("$.response.id"), _json("$.responseId"), _json("$.id"))).alias("message_id"),
        _last(F.coalesce(_json("$.message.model"), _json("$.response.model"), _json("$.modelVersion"), _json("$.model"))).alias("model"),
        F.coalesce(_last(_usage("$.message.usage.input_tokens", "$.usage.input_tokens")), F.lit(0)).alias("_plain"),
        F.coalesce(_last(in_input), F.lit(0)).alias("_whole"),
        F.coalesce(_last(cached), F.lit(0)).alias("_cached"),
        F.coalesce(_last(output), F.lit(0)).alias("output_tokens"),
        F.coalesce(_last(_usage("$.message.usage.cache_creation_input_tokens", "$.usage.cache_creation_input_tokens")), F.lit(0)).alias("cache_create_tokens"),
        F.coalesce(_last(_usage("$.message.usage.cache_read_input_tokens", "$.usage.cache_read_input_tokens")), F.lit(0)).alias("_read"),
        F.min("ts_ms").alias("request_start_time"),
        F.max("ts_ms").alias("timestamp"),
        (F.min(F.when(content, F.col("ts_ms"))) - F.min("ts_ms")).alias("ttft_ms"),
    )
    split = without_cache(F.col("_whole"), F.col("_cached"), clamp=False)
    foreign = F.col("_whole") > 0
    duration = F.col("timestamp") - F.col("request_start_time")
    counted = out.withColumns({"input_tokens": F.when(foreign, split["input"]).otherwise(F.col("_plain")), "cache_read_tokens": F.when(foreign, split["cache_read"]).otherwise(F.col("_read")), "duration_ms": duration, "output_tokens_per_second": rate_per_second(F.col("output_tokens"), duration)})
    return counted.drop("_plain", "_whole", "_cached", "_read")


def captured(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """``folded`` on a stream, for append mode: one record for each request, once nothing has come of it for ``gap`` and the watermark has passed.

    A request is a session of its events, on whatever days they lie. Its state goes with its record. Events of one request that lie further apart than
    ``gap`` make records of their own.
    """
    timed = events.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)
    return folded(timed, F.session_window("event_time", gap).alias("_session")).drop("_session")


def recent_unique(records: DataFrame, key: str = "storage_dedupe_key", delay: str = "10 minutes", event_time: str = "event_time") -> DataFrame:
    """A stream without repeated records of one key within the delay."""
    return records.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def recent_largest(records: DataFrame, key: str = "storage_dedupe_key", delay: str = "10 minutes", event_time: str = "event_time", keep: str = "2 days") -> DataFrame:
    """For update mode: of one key's records the one of most tokens so far, then the latest. A larger one that comes later replaces it, also after midnight.

    What is remembered of a key, its total and time, goes when the watermark is ``keep`` behind the record shown.
    """
    kept_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def newest(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, row = state.get if state.exists else None, None
        for frame in frames:
            total = frame[list(_COUNTS)].fillna(0).sum(axis=1).astype("int64")
            at = frame[event_time].astype("datetime64[us]").astype("int64")
            for i, found in enumerate(zip(total.tolist(), at.tolist(), strict=True)):
                if best is None or found > tuple(best):
                    best, row = found, frame.iloc[[i]]
        state.update(tuple(best))
        state.setTimeoutTimestamp(max(best[1] // 1000 + kept_ms, state.getCurrentWatermarkMs() + 1))
        if row is not None:
            yield row

    timed = records.withWatermark(event_time, delay)
    return timed.groupBy(key).applyInPandasWithState(newest, records.schema, "total long, at long", "update", GroupStateTimeout.EventTimeTimeout)


def largest_per_key(records: DataFrame, key: str = "storage_dedupe_key") -> DataFrame:
    """Of one key's records the one of most tokens, then the latest: later, larger records replace earlier ones."""
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_create_tokens") + F.col("cache_read_tokens")
    order = Window.partitionBy(key).orderBy(F.desc(total), F.desc("timestamp"))
    return records.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def session_totals(records: DataFrame) -> DataFrame:
    """Running totals of sessions, for update mode on a stream or as a batch."""
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")]
    return records.groupBy("session_id").agg(F.count("*").alias("requests"), *sums, F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


def hourly_windows(records: DataFrame, delay: str = "1 day") -> DataFrame:
    """Requests and tokens by tumbling hour."""
    timed = records.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", "1 hour")).agg(F.count("*").alias("requests"), F.sum("output_tokens").alias("output_tokens"))
