"""One-to-one matching of unresolved proxy records with local ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.models import base_model
from meterlake.functions.numbers import total_tokens

NEAR_SECONDS, BEST_SECONDS, CLEAR_SECONDS = 30, 5, 10
_TOKENS = ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")


_RESULT = "row string, request_key string, session_id string, state string"
_SCHEMA = pa.schema([(c, pa.string()) for c in ("row", "request_key", "session_id", "state")])


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (group, at, local, name, session_id) in the order of group and time; only those within NEAR_SECONDS are held.

    A proxy record is settled once no local one near it can follow; a local record that is taken is gone, if it has a name.
    """
    waiting, free, out, now = deque(), deque(), [], None

    def settle(until: int | None) -> None:
        while waiting and (until is None or waiting[0][0] + NEAR_SECONDS < until):
            at, row = waiting.popleft()
            while free and free[0][0] < at - NEAR_SECONDS:
                free.popleft()
            near = sorted(((abs(x[0] - at), i) for i, x in enumerate(free) if not x[3] and abs(x[0] - at) <= NEAR_SECONDS))
            if len(near) == 1 or (len(near) > 1 and near[0][0] <= BEST_SECONDS and near[1][0] - near[0][0] >= CLEAR_SECONDS):
                best = free[near[0][1]]
                # a key may stand in several rows, which are taken together; a row without one is never used up
                for x in free:
                    x[3] = x[3] or (best[1] is not None and x[1] == best[1])
                out.append((row, best[1], best[2], "known"))
            else:
                out.append((row, None, None, "ambiguous" if near else "unmatched"))

    for batch in _and_end(batches):
        if batch is None:
            settle(None)
        else:
            columns = [c.to_pylist() for c in batch.columns]
            for *group, at, is_local, name, session in zip(*columns, strict=True):
                if group != now:
                    settle(None)
                    free.clear()
                    now = group
                settle(at)
                if is_local:
                    least = (waiting[0][0] if waiting else at) - NEAR_SECONDS
                    while free and free[0][0] < least:
                        free.popleft()
                    free.append([at, name, session, False])
                else:
                    waiting.append((at, name))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], schema=_SCHEMA)
        out.clear()


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def match_records(proxy: DataFrame, local: DataFrame, row: str = "message_id") -> DataFrame:
    """(row, request_key, session_id, state) for each proxy record.

    Records match if all token counts, the total too, and the model agree and they lie within 30 seconds: a single one is taken, and of
    several the nearest if it is within 5 seconds and clearly nearer than the next. A total that isn't stated is the sum of the counts. A local
    record is taken once, but for those without a request key, which any number of proxy records may match. What is taken depends on the order
    of records, within a group that shares counts, model and a run of times: records further apart than 30 seconds
    from all before them open a new run. A run may be as long as its key: it is streamed in the order of time, and only
    the records within 30 seconds are held. One run is still one task's work.
    """
    def counts(rows: DataFrame) -> list[Column]:
        whole = total_tokens(*(F.coalesce(c, F.lit(0)) for c in _TOKENS))
        return [*(F.col(c) for c in _TOKENS), (F.coalesce("total_tokens", whole) if "total_tokens" in rows.columns else whole).alias("total_tokens")]

    p = proxy.select(F.col(row).cast("string").alias("row"), F.expr("CASE WHEN request_end_time > 0 THEN request_end_time ELSE timestamp END div 1000").alias("at"), *counts(proxy), base_model(F.col("model")).alias("m"))
    free = local.select(F.col("request_key"), F.col("session_id"), F.col("timestamp").alias("at"), *counts(local), base_model(F.col("model")).alias("m"))
    group = [*_TOKENS, "total_tokens", "m"]
    times = p.select(*group, "at").unionByName(free.select(*group, "at")).distinct()
    order = Window.partitionBy(*group).orderBy("at")
    opens = F.coalesce((F.col("at") - F.lag("at").over(order) > NEAR_SECONDS).cast("int"), F.lit(1))
    runs = times.withColumn("_open", opens).withColumn("run", F.sum("_open").over(order)).drop("_open")
    keys = [*group, "run"]
    timed = [*group, "at"]
    left = p.join(runs, timed).select(*keys, "at", F.lit(False).alias("local"), F.col("row").alias("name"), F.lit(None).cast("string").alias("session_id"))
    right = free.join(runs, timed).select(*keys, "at", F.lit(True).alias("local"), F.col("request_key").cast("string").alias("name"), F.col("session_id").cast("string").alias("session_id"))
    both = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "at", F.col("name").asc_nulls_last())
    return both.mapInArrow(_assigned, _RESULT).where("row IS NOT NULL")
