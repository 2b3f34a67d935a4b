"""Queries: readers over files and exported tables that are made from the supplied conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.plans import folders
from meterlake.queries.bindings import END, START, read
from meterlake.queries.registry import query
from meterlake.queries.stored import _folder
from meterlake.sources import transcripts
from meterlake.sources.registry import SOURCES, KeysetCheckpoint, ScanCache

_SHOWN = ("message_id", "model", "timestamp", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens", "total_tokens")
#: One request for each turn that is not the user's.
_TURNS = "SELECT conv_id, turn, conv_id * 100 + turn AS id, length(text) AS n, 1704067200 + conv_id * 60 + turn AS ts FROM conversations WHERE role <> 'user'"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("role <> 'user'")
    return c.select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.length("text").cast("long").alias("n"), (F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("at"))


def _files(spark: SparkSession, lines: DataFrame, suffix: str) -> str:
    """A folder of text files of the lines (conv_id, turn, line), each conversation in one file and in order."""
    path = _folder(spark, "transcripts")
    lines.repartition(4, "conv_id").sortWithinPartitions("conv_id", "turn", "line").select("line").write.text(path)
    for name in folders.children(spark, path):
        if name.endswith(".txt"):
            folders.rename(spark, f"{path}/{name}", f"{path}/{name.removesuffix('.txt')}{suffix}")
    return path


def _renamed(spark: SparkSession, path: str, suffix: str = ".jsonl") -> str:
    """The text files in the folders of a folder, under another suffix."""
    for folder in folders.children(spark, path):
        for name in folders.children(spark, f"{path}/{folder}") if "=" in folder else ():
            if name.endswith(".txt"):
                folders.rename(spark, f"{path}/{folder}/{name}", f"{path}/{folder}/{name.removesuffix('.txt')}{suffix}")
    return path


def _id() -> Column:
    return F.col("id").cast("string")


@query(f"SELECT CAST(id AS VARCHAR) AS message_id, CASE WHEN turn % 5 = 4 THEN '' ELSE 'm-1' END AS model, ts AS timestamp, n AS input_tokens, n % 50 AS output_tokens, CASE WHEN turn % 5 = 4 THEN 0 ELSE turn END AS cache_create_tokens, CASE WHEN turn % 5 = 4 THEN 0 ELSE n % 7 END AS cache_read_tokens, n + n % 50 + CASE WHEN turn % 5 = 4 THEN 0 ELSE turn + n % 7 END AS total_tokens FROM ({_TURNS}) WHERE n > 0")
def read_assistant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in versions, of which the largest stays, and usage objects at an unknown depth."""
    t = _turns(spark, sf_dir)
    plain = F.format_string('{"type":"assistant","timestamp":%d,"message":{"id":"%d","model":"m-1","usage":{"input_tokens":%d,"output_tokens":%d,"cache_creation_input_tokens":%d,"cache_read_input_tokens":%d}}}', "at", "id", "n", F.col("v"), "turn", F.col("n") % 7)
    deep = F.format_string('{"type":"assistant","timestamp":%d,"uuid":"%d","deep":[{"x":{"prompt_tokens":%d,"completion_tokens":%d}}]}', "at", "id", "n", F.col("v"))
    versions = t.withColumn("v", F.explode(F.array(F.col("n") % 50, F.lit(0).cast("long"))))
    lines = versions.select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, deep).otherwise(plain).alias("line"))
    noise = t.select("conv_id", "turn", F.lit('{"type":"user","message":{"usage":{"input_tokens":1}}}').alias("line"))
    return transcripts.assistant_lines(spark, _files(spark, lines.unionByName(noise), ".jsonl")).select(*_SHOWN)


@query(f"SELECT 'm-' || CAST(conv_id % 3 AS VARCHAR) AS model, ts AS timestamp, greatest(n - n // 3, 0) AS input_tokens, n % 11 AS output_tokens, CAST(turn AS BIGINT) AS cache_create_tokens, n // 3 AS cache_read_tokens, n + n % 11 + turn AS total_tokens FROM ({_TURNS}) WHERE n + n % 11 + turn > 0")
def read_agent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model is said once and carried on; cached tokens are taken out of the input."""
    t = _turns(spark, sf_dir)
    change = t.groupBy("conv_id").agg((F.min("turn") - 1).alias("turn")).select("conv_id", "turn", F.format_string('{"type":"model_change","modelId":"m-%d"}', F.col("conv_id") % 3).alias("line"))
    usage = F.format_string('{"timestamp":%d,"message":{"role":"assistant","usage":{"input":%d,"output":%d,"cacheRead":%d,"cacheWrite":%d}}}', "at", "n", F.col("n") % 11, F.expr("n div 3"), "turn")
    return transcripts.agent_lines(spark, _files(spark, change.unionByName(t.select("conv_id", "turn", usage.alias("line"))), ".jsonl.archived")).select(*_SHOWN[1:])


@query(f"SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'own' || conv_id % 4 ELSE 'p' || conv_id % 7 END AS project_name, count(*) AS request_count, min(ts) AS start_time, max(ts) AS end_time FROM ({_TURNS}) GROUP BY conv_id")
def read_folder_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in folders that are named for the project's path; some state their working folder themselves."""
    t = _turns(spark, sf_dir)
    cwd = F.when(F.col("conv_id") % 3 == 0, F.format_string(',"cwd":"/w/own%d"', F.col("conv_id") % 4)).otherwise("")
    line = F.concat(F.format_string('{"sessionId":"%d","timestamp":%d,"role":"assistant"', "conv_id", "at"), cwd, F.lit("}"))
    path = f"{_folder(spark, 'transcripts')}/projects"
    folder = F.concat(F.lit("-home-u-p"), (F.col("conv_id") % 7).cast("string"))
    t.select(folder.alias("of"), line.alias("line")).repartition(4, "of").write.partitionBy("of").text(path)
    found = transcripts.folder_sessions(spark, _renamed(spark, path))
    return found.select("session_id", "project_name", "request_count", "start_time", "end_time")


@query(f"SELECT ts AS timestamp, n AS input_tokens, n % 13 AS output_tokens, n + n % 13 AS total_tokens FROM ({_TURNS}) WHERE n > 0")
def read_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log text in which some lines hold the final counts of a message."""
    t = _turns(spark, sf_dir)
    time = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat(F.lit("["), time, F.format_string('] info stream_event: {"type":"message_delta","usage":{"input_tokens":%d,"output_tokens":%d}} end', "n", F.col("n") % 13))
    start = F.concat(F.lit("["), time, F.lit('] stream_event {"type":"message_start"}'))
    lines = t.select("conv_id", "turn", F.explode(F.array(line, start, F.lit("noise"))).alias("line"))
    return transcripts.log_lines(spark, _files(spark, lines, ".log")).select("timestamp", "input_tokens", "output_tokens", "total_tokens")


@query(f"SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(id AS VARCHAR) AS message_id, ts AS timestamp, n AS input_tokens, n % 5 + n % 3 AS output_tokens, CAST(turn AS BIGINT) AS cache_create_tokens, n % 7 AS cache_read_tokens FROM ({_TURNS}) WHERE (conv_id % 2 = 0 OR ts >= 1704067200 + conv_id * 60 + 2) AND n + turn > 0")
def exported_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a message table with JSON; those older than their session were copied by a fork."""
    t = _turns(spark, sf_dir)
    data = F.format_string('{"role":"assistant","modelID":"m","tokens":{"input":%d,"output":%d,"reasoning":%d,"cache":{"write":%d,"read":%d}}}', "n", F.col("n") % 5, F.col("n") % 3, "turn", F.col("n") % 7)
    rows = t.select(_id().alias("id"), F.col("conv_id").cast("string").alias("session_id"), (F.col("at") * 1000).alias("time_created"), data.alias("data"))
    starts = t.select(F.col("conv_id").cast("string").alias("session_id"), F.when(F.col("conv_id") % 2 == 1, (F.lit(1704067200) + F.col("conv_id") * 60 + 2) * 1000).alias("time_created")).distinct()
    return transcripts.database_messages(rows, fork_start=starts).select("session_id", "message_id", "timestamp", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")


@query(f"SELECT CAST(conv_id AS VARCHAR) AS session_id, max(ts) AS timestamp, CAST(sum(n) AS BIGINT) AS input_tokens, CAST(sum(n % 9) AS BIGINT) AS output_tokens, count(*) AS request_count FROM ({_TURNS}) GROUP BY conv_id HAVING sum(n + n % 9) > 0")
def exported_session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each session row, which weighs as many as it has messages."""
    zero = F.lit(0).cast("long")
    rows = _turns(spark, sf_dir).groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.lit("m").alias("model"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count("*").alias("message_count"), F.sum("n").alias("input_tokens"), F.sum(F.col("n") % 9).alias("output_tokens"), F.max(zero).alias("cache_read_tokens"), F.max(zero).alias("cache_write_tokens"), F.max(F.lit(0.5)).alias("estimated_cost_usd"), F.max(F.lit(None).cast("double")).alias("actual_cost_usd"))
    return transcripts.session_totals(rows).select("session_id", "timestamp", "input_tokens", "output_tokens", "request_count")


@query(f"SELECT CAST(id AS VARCHAR) AS message_id, ts AS timestamp, n - n // 4 AS input_tokens, n % 6 AS output_tokens, n // 4 AS cache_read_tokens FROM ({_TURNS}) WHERE conv_id % 3 <> 0 AND n > 0")
def exported_editor_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of known sessions, with counts and model in JSON columns."""
    t = _turns(spark, sf_dir)
    known = t.where("conv_id % 3 <> 0").select(F.col("conv_id").cast("string").alias("session_id")).distinct()
    info = F.format_string('{"promptTokens":%d,"cachedTokens":%d,"completionTokens":%d}', "n", F.expr("n div 4"), F.col("n") % 6)
    rows = t.select(_id().alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.lit("assistant").alias("role"), (F.col("at") * 1000).alias("created"), info.alias("token_info"), F.lit('{"model":"q"}').alias("model_info"))
    return transcripts.editor_messages(known, rows).select("message_id", "timestamp", "input_tokens", "output_tokens", "cache_read_tokens")


@query(f"SELECT CAST(conv_id AS VARCHAR) AS session_id, least(count(*), greatest(sum(n) - sum(n // 4), sum(n % 6), sum(n // 4))) AS requests, CAST(sum(n) - least(sum(n), sum(n // 4)) AS BIGINT) AS input_tokens, CAST(sum(n % 6) AS BIGINT) AS output_tokens, CAST(least(sum(n), sum(n // 4)) AS BIGINT) AS cache_read_tokens, min(ts) AS first FROM ({_TURNS}) GROUP BY conv_id HAVING sum(n) > 0")
def read_shutdown_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that a session ends with, dealt out to its requests: none is lost, and the first is where the session begins."""
    t = _turns(spark, sf_dir)
    start = t.select("conv_id", "turn", F.format_string('{"sessionId":"%d","timestamp":%d,"type":"assistant.message","data":{"outputTokens":1}}', "conv_id", "at").alias("line"))
    sums = t.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"), F.max("at").alias("at"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.expr("n div 4")).alias("c"), F.sum(F.col("n") % 6).alias("o"))
    end = F.format_string('{"sessionId":"%d","timestamp":%d,"type":"session.shutdown","data":{"modelMetrics":{"m":{"requests":{"count":%d},"usage":{"inputTokens":%d,"outputTokens":%d,"cacheReadTokens":%d,"cacheWriteTokens":0}}}}}', "conv_id", "at", "k", "n", "o", "c")
    # totals that don't go round leave requests without any token, which are none
    lines = start.unionByName(sums.select("conv_id", "turn", end.alias("line")))
    found = transcripts.shutdown_totals(spark, _files(spark, lines, ".jsonl"))
    return found.groupBy("session_id").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens")), F.min("timestamp").alias("first"))


@query(f"SELECT CAST(conv_id % 4 AS VARCHAR) AS model, count(*) AS requests, CAST(sum(n + CASE WHEN conv_id % 4 = 1 THEN 2 ELSE 0 END) AS BIGINT) AS input_tokens FROM ({_TURNS}) WHERE conv_id % 4 <> 2 AND n > 0 GROUP BY 1")
def rescanned_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that stay, that come in another version, that go, and that are new, after a second look at a source."""
    t = _turns(spark, sf_dir)

    def folder(which: int, more: int = 0) -> str:
        line = F.format_string('{"type":"assistant","timestamp":%d,"message":{"id":"%d","model":"%d","usage":{"input_tokens":%d,"output_tokens":0}}}', "at", "id", F.col("conv_id") % 4, F.col("n") + F.when(F.col("n") > 0, more).otherwise(0))
        return _files(spark, t.where(F.col("conv_id") % 4 == which).select("conv_id", "turn", line.alias("line")), ".jsonl")

    same, old, gone, changed, new = folder(0), folder(1), folder(2), folder(1, 2), folder(3)
    cache = ScanCache(spark, _folder(spark, "scans"), SOURCES["claude_code"])
    cache.refresh([same, old, gone])
    cache.refresh([same, changed, new])
    return cache.read().groupBy("model").agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"))


@query(f"SELECT event_id, CASE WHEN epoch_ms(ts) >= {END * 1000} THEN 3 WHEN epoch_ms(ts) >= {START * 1000} THEN 2 ELSE 1 END AS read_no FROM events")
def rows_behind_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that grows while it is read: three reads, each of what has come since the one before, have every row once."""
    table = read(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    folder = _folder(spark, "growing")
    at = KeysetCheckpoint(spark, _folder(spark, "checkpoint"), "ms", "event_id")
    edges = [None, START * 1000, END * 1000, None]

    def arrive(i: int) -> DataFrame:
        lower, upper = edges[i], edges[i + 1]
        new = table.where((F.lit(True) if lower is None else F.col("ms") >= lower) & (F.lit(True) if upper is None else F.col("ms") < upper))
        new.write.mode("append").parquet(folder)
        return spark.read.parquet(folder)

    out, rows = None, arrive(0)
    for i in range(3):
        found = at.unread(rows)
        if i < 2:
            rows = arrive(i + 1)  # before what was found has been taken in
        out_rows = found.rows.select("event_id", F.lit(i + 1).alias("read_no"))
        out = out_rows if out is None else out.unionByName(out_rows)
        at.advance(found)
    return out
