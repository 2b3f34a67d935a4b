"""Transcripts of each tool as LOCAL requests. Every reader gives one row for each request that used tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions.keys import is_blank, project_name
from meterlake.functions.models import base_model, dated_model
from meterlake.functions.numbers import first_number, first_time, share_of, spread_between, without_cache
from meterlake.operators.sequences import after_fork, carried, counter_deltas, keep_largest, numbered
from meterlake.schemas import LOCAL, conform
from meterlake.sources.files import documents, file_stem, folder_project, lines, numbered_lines, root_session


def _json(path: str, column: str = "line") -> Column:
    return F.get_json_object(column, path)


def _requests(rows: DataFrame, tool: str) -> DataFrame:
    """LOCAL rows with their totals; rows that used nothing leave."""
    filled = rows.withColumns({"tool": F.lit(tool)} | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens") if c in rows.columns})
    total = F.lit(0)
    for c in ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens"):
        total = total + (F.col(c) if c in rows.columns else F.lit(0))
    counted = filled.withColumn("total_tokens", F.coalesce(F.col("total_tokens"), total) if "total_tokens" in rows.columns else total)
    if "request_count" not in rows.columns:
        counted = counted.withColumn("request_count", F.lit(1))
    return conform(counted.where("total_tokens > 0"), LOCAL)


def _nested_usage(body: str | None) -> str | None:
    """The first object anywhere in a JSON text that names token counts: depth is unbounded, which no path expression can follow."""
    import json

    names = ("input_tokens", "output_tokens", "inputTokens", "outputTokens", "prompt_tokens", "completion_tokens")
    try:
        todo = [json.loads(body or "")]
    except ValueError:
        return None
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            if any(n in x for n in names):
                return json.dumps(x)
            todo[:0] = x.values()
        elif isinstance(x, list):
            todo[:0] = x
    return None


#: In Arrow batches; asked only where no path has found a usage object.
nested_usage = F.udf(_nested_usage, T.StringType(), useArrow=True)


def assistant_lines(spark: SparkSession, path: str | Sequence[str], tool: str = "claude_code") -> DataFrame:
    """JSON lines with an assistant message and its usage; of one message's versions the largest. Subagents' files belong to their session."""
    at = lines(spark, path).where(_json("$.type") == "assistant")
    placed = at.withColumn("usage", F.coalesce(_json("$.message.usage"), _json("$.usage")))
    # only lines without a usage where it should be are searched in Python
    deep = placed.where("usage IS NULL").withColumn("usage", nested_usage(F.col("line")))
    rows = placed.where("usage IS NOT NULL").unionByName(deep).select(
        root_session(F.col("path")).alias("session_id"),
        F.coalesce(_json("$.message.id"), _json("$.uuid"), F.lit("")).alias("message_id"),
        F.coalesce(_json("$.message.model"), _json("$.model"), F.lit("")).alias("model"),
        first_time(F.col("line"), ["$.timestamp", "$.message.timestamp"]).alias("timestamp"),
        first_number(F.col("usage"), ["$.input_tokens", "$.inputTokens", "$.prompt_tokens"]).alias("input_tokens"),
        first_number(F.col("usage"), ["$.output_tokens", "$.outputTokens", "$.completion_tokens"]).alias("output_tokens"),
        first_number(F.col("usage"), ["$.cache_creation_input_tokens", "$.cacheCreationInputTokens"]).alias("cache_create_tokens"),
        first_number(F.col("usage"), ["$.cache_read_input_tokens", "$.cacheReadInputTokens"]).alias("cache_read_tokens"),
    )
    found = _requests(rows, tool)
    unnamed = found.where(is_blank(F.col("message_id")))
    named = keep_largest(found.where(~is_blank(F.col("message_id"))), ["session_id", "message_id"])
    return named.unionByName(unnamed)


def rollout_lines(spark: SparkSession, path: str | Sequence[str], tool: str = "codex") -> DataFrame:
    """Events with cumulative counters: deltas by file, the model carried from the last context, replays of a fork skipped."""
    raw = lines(spark, path).withColumns({"type": _json("$.type"), "ts": first_time(F.col("line"), ["$.timestamp"])})
    counter = lambda at: F.when(_json(at).isNotNull(), F.struct(*(F.coalesce(first_number(_json(at), [f"$.{k}"]), F.lit(0)).alias(n) for n, k in (("input", "input_tokens"), ("output", "output_tokens"), ("cache_create", "cache_creation_input_tokens"), ("cache_read", "cached_input_tokens")))))
    events = raw.withColumns(
        {
            "is_count": (F.col("type") == "event_msg") & (_json("$.payload.type") == "token_count"),
            "model": F.coalesce(_json("$.payload.info.model"), F.when(F.col("type") == "turn_context", _json("$.payload.model")), F.lit("")),
            "fork_start": F.when((F.col("type") == "session_meta") & _json("$.payload.forked_from_id").isNotNull(), F.col("ts")),
            "session": F.when(F.col("type") == "session_meta", _json("$.payload.id")),
            "total": counter("$.payload.info.total_token_usage"),
            "last": counter("$.payload.info.last_token_usage"),
        }
    )
    whole = Window.partitionBy("path")
    events = carried(events, "model", "path", ["place"]).withColumns({"fork_start": F.max("fork_start").over(whole), "session_id": F.coalesce(F.max("session").over(whole), file_stem(F.col("path")))})
    counts = events.where("is_count AND (total IS NOT NULL OR last IS NOT NULL)")
    deltas = after_fork(counter_deltas(counts, "path", ["place"]), "ts", "fork_start")
    rows = deltas.select(
        "session_id",
        "path",
        "place",
        F.col("ts").alias("timestamp"),
        dated_model(F.col("model")).alias("model"),
        F.col("delta.input").alias("input_tokens"),
        F.col("delta.output").alias("output_tokens"),
        F.col("delta.cache_create").alias("cache_create_tokens"),
        F.col("delta.cache_read").alias("cache_read_tokens"),
    ).where("input_tokens + output_tokens + cache_create_tokens + cache_read_tokens > 0")
    indexed = numbered(rows, "session_id", ["path", "place"])
    return _requests(indexed.withColumn("message_id", F.concat_ws(":", F.lit(tool), "session_id", F.col("event_index").cast("string"))), tool)


def chat_documents(spark: SparkSession, path: str | Sequence[str], tool: str = "gemini") -> DataFrame:
    """Documents with a list of messages; cached tokens are part of the input, thoughts and tool tokens of the output."""
    messages = F.from_json(_json("$.messages", "body"), "array<string>")
    each = documents(spark, path).select("path", _json("$.sessionId", "body").alias("session"), F.posexplode(messages).alias("line_no", "line"))
    number = lambda *keys: F.coalesce(first_number(F.col("line"), [f"$.tokens.{k}" for k in keys]), F.lit(0))
    split = without_cache(number("input"), number("cached"), clamp=True)
    rows = each.where(_json("$.tokens").isNotNull()).select(
        F.coalesce("session", file_stem(F.col("path"))).alias("session_id"),
        F.coalesce(_json("$.id"), F.lit("")).alias("message_id"),
        base_model(F.coalesce(_json("$.model"), F.lit(""))).alias("model"),
        first_time(F.col("line"), ["$.timestamp"]).alias("timestamp"),
        split["input"].alias("input_tokens"),
        (number("output") + number("thoughts") + number("tool")).alias("output_tokens"),
        F.lit(0).alias("cache_create_tokens"),
        split["cache_read"].alias("cache_read_tokens"),
    )
    found = _requests(rows, tool)
    return keep_largest(found.where(~is_blank(F.col("message_id"))), ["session_id", "message_id"]).unionByName(found.where(is_blank(F.col("message_id"))))


def shutdown_totals(spark: SparkSession, path: str | Sequence[str], tool: str = "copilot_cli") -> DataFrame:
    """Sessions that end with totals by model: the totals are spread evenly over their requests and over the session's time; without an end, one request for each assistant event."""
    at = lines(spark, path).withColumns({"session_id": F.coalesce(_json("$.sessionId"), root_session(F.col("path"))), "ts": first_time(F.col("line"), ["$.timestamp"]), "type": _json("$.type")})
    span = at.groupBy("session_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    usage = "struct<requests:struct<count:long>,usage:struct<inputTokens:long,outputTokens:long,cacheReadTokens:long,cacheWriteTokens:long>>"
    ends = at.where("type = 'session.shutdown'").select("session_id", F.explode(F.from_json(_json("$.data.modelMetrics"), f"map<string,{usage}>")).alias("model", "m"))
    sums = ends.groupBy("session_id", "model").agg(F.greatest(F.sum(F.coalesce("m.requests.count", F.lit(1))), F.lit(1)).alias("n"), *(F.coalesce(F.sum(f"m.usage.{k}"), F.lit(0)).alias(k) for k in ("inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens")))
    whole = Window.partitionBy("session_id").orderBy("model").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.withColumns({"before": F.coalesce(F.sum("n").over(whole), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("session_id"))}).join(span, "session_id").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    i, n = F.col("i"), F.col("n")
    split = without_cache(F.col("inputTokens"), F.col("cacheReadTokens"), clamp=True)
    spread = parts.select(
        "session_id",
        F.concat_ws(":", F.lit(tool), "session_id", "model", i.cast("string")).alias("message_id"),
        "model",
        spread_between(F.col("first"), F.col("last"), F.col("before") + i, F.col("all")).alias("timestamp"),
        share_of(split["input"], i, n).alias("input_tokens"),
        share_of(F.col("outputTokens"), i, n).alias("output_tokens"),
        share_of(F.col("cacheWriteTokens"), i, n).alias("cache_create_tokens"),
        share_of(split["cache_read"], i, n).alias("cache_read_tokens"),
    )
    live = at.where("type = 'assistant.message'").join(ends.select("session_id").distinct(), "session_id", "left_anti")
    single = live.select("session_id", F.coalesce(_json("$.data.messageId"), F.lit("")).alias("message_id"), F.coalesce(_json("$.data.model"), F.lit("")).alias("model"), F.col("ts").alias("timestamp"), F.lit(0).cast("long").alias("input_tokens"), first_number(F.col("line"), ["$.data.outputTokens"]).alias("output_tokens"), F.lit(0).cast("long").alias("cache_create_tokens"), F.lit(0).cast("long").alias("cache_read_tokens"))
    return _requests(spread.unionByName(single), tool)


def agent_lines(spark: SparkSession, path: str | Sequence[str], tool: str = "openclaw") -> DataFrame:
    """Agent transcripts, archived ones too: input without what was cached, the model carried on, ids made from file and line."""
    at = numbered_lines(spark, path, glob="*.jsonl*")
    rows = at.withColumn("model", F.coalesce(_json("$.message.model"), _json("$.modelId"), F.lit("")))
    rows = carried(rows, "model", "path", ["line_no"]).where(_json("$.message.role") == "assistant")
    usage = _json("$.message.usage")
    split = without_cache(F.coalesce(first_number(usage, ["$.input"]), F.lit(0)), F.coalesce(first_number(usage, ["$.cacheRead"]), F.lit(0)), clamp=False)
    session = file_stem(F.col("path"))
    return _requests(
        rows.select(
            session.alias("session_id"),
            F.concat_ws(":", F.lit(tool), session, F.regexp_extract("path", r"([^/]+)$", 1), F.col("line_no").cast("string")).alias("message_id"),
            "model",
            first_time(F.col("line"), ["$.timestamp", "$.message.timestamp"]).alias("timestamp"),
            split["input"].alias("input_tokens"),
            first_number(usage, ["$.output"]).alias("output_tokens"),
            first_number(usage, ["$.cacheWrite"]).alias("cache_create_tokens"),
            split["cache_read"].alias("cache_read_tokens"),
        ),
        tool,
    )


def log_lines(spark: SparkSession, path: str | Sequence[str], tool: str = "qoder_work", marker: str = "stream_event") -> DataFrame:
    """Log text: after a marker, JSON between the first and the last brace; only final counts of a message matter. A leading [time] is the time."""
    at = numbered_lines(spark, path, glob="*.log", least_bytes=1, wanted=F.col("line").contains(marker) & F.col("line").contains("message_delta"))
    body = F.regexp_extract("line", marker + r"[^{]*(\{.*\})", 1)
    seconds = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract("line", r"^\[([^\]]+)\]", 1)))
    rows = at.withColumns({"body": body, "ts": seconds}).where(F.coalesce(F.get_json_object("body", "$.type"), F.get_json_object("body", "$.event.type")) == "message_delta")
    usage = F.coalesce(F.get_json_object("body", "$.usage"), F.get_json_object("body", "$.event.usage"))
    number = lambda k: F.coalesce(first_number(usage, [f"$.{k}"]), F.lit(0))
    found = rows.select(F.coalesce(F.get_json_object("body", "$.session_id"), file_stem(F.col("path"))).alias("session_id"), F.lit("").alias("model"), F.col("ts").alias("timestamp"), number("input_tokens").alias("input_tokens"), number("output_tokens").alias("output_tokens"), number("cache_creation_input_tokens").alias("cache_create_tokens"), number("cache_read_input_tokens").alias("cache_read_tokens"), "line_no")
    named = found.withColumn("message_id", F.concat_ws(":", F.lit(tool), F.col("line_no").cast("string"), F.col("timestamp").cast("string"), F.col("input_tokens").cast("string"), F.col("output_tokens").cast("string")))
    return _requests(named, tool)


def database_messages(rows: DataFrame, tool: str = "opencode", fork_start: DataFrame | None = None) -> DataFrame:
    """Exported message rows (id, session_id, time_created in ms, data as JSON): assistant messages with their tokens; replays of a fork skipped."""
    from meterlake.operators.sequences import without_fork_replays

    own = rows if fork_start is None else without_fork_replays(rows, fork_start)
    data = F.col("data")
    number = lambda *k: F.coalesce(first_number(data, [f"$.tokens.{x}" for x in k]), F.lit(0))
    return _requests(
        own.where(F.get_json_object(data, "$.role") == "assistant").select(
            "session_id",
            F.col("id").alias("message_id"),
            F.coalesce(F.get_json_object(data, "$.modelID"), F.get_json_object(data, "$.model.modelID"), F.lit("")).alias("model"),
            F.expr("time_created div 1000").alias("timestamp"),
            number("input").alias("input_tokens"),
            (number("output") + number("reasoning")).alias("output_tokens"),
            number("cache.write").alias("cache_create_tokens"),
            number("cache.read").alias("cache_read_tokens"),
        ),
        tool,
    )


def database_over_files(database: DataFrame, files: DataFrame) -> DataFrame:
    """Messages of both; where both have one, the database's stands."""
    both = database.withColumn("_db", F.lit(1)).unionByName(files.withColumn("_db", F.lit(0)))
    order = Window.partitionBy("session_id", "message_id").orderBy(F.desc("_db"), F.desc("total_tokens"), "timestamp")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_db")


def message_documents(spark: SparkSession, path: str | Sequence[str], tool: str = "opencode") -> DataFrame:
    """One JSON file for each message, in the shape of ``database_messages``."""
    docs = documents(spark, path).select(F.coalesce(_json("$.id", "body"), file_stem(F.col("path"))).alias("id"), F.coalesce(_json("$.sessionID", "body"), _json("$.session_id", "body")).alias("session_id"), F.coalesce(first_number(F.col("body"), ["$.time.created", "$.time_created"]), F.lit(0)).alias("time_created"), F.col("body").alias("data"))
    return database_messages(docs.where("session_id IS NOT NULL"), tool)


def session_totals(rows: DataFrame, tool: str = "hermes") -> DataFrame:
    """Exported session rows with totals: one request for each, which stands for all of its messages."""
    return _requests(
        rows.select(
            F.col("id").alias("session_id"),
            F.concat_ws(":", F.lit(tool), "id").alias("message_id"),
            F.coalesce("model", F.lit("")).alias("model"),
            F.coalesce("ended_at", "started_at").cast("long").alias("timestamp"),
            "input_tokens",
            "output_tokens",
            F.col("cache_write_tokens").alias("cache_create_tokens"),
            "cache_read_tokens",
            F.greatest(F.coalesce("message_count", F.lit(1)), F.lit(1)).alias("request_count"),
            F.coalesce("actual_cost_usd", "estimated_cost_usd").alias("explicit_estimated_cost"),
        ),
        tool,
    )


def editor_messages(sessions: DataFrame, messages: DataFrame, tool: str = "qoder_ide") -> DataFrame:
    """Exported sessions and their messages with JSON columns token_info and model_info, in one join."""
    info = F.col("token_info")
    split = without_cache(F.coalesce(first_number(info, ["$.promptTokens", "$.prompt_tokens"]), F.lit(0)), F.coalesce(first_number(info, ["$.cachedTokens", "$.cached_tokens"]), F.lit(0)), clamp=False)
    own = messages.where("role = 'assistant'").join(sessions.select("session_id"), "session_id", "left_semi")
    return _requests(
        own.select(
            "session_id",
            F.col("id").alias("message_id"),
            F.coalesce(F.get_json_object("model_info", "$.model"), F.get_json_object("model_info", "$.name"), F.lit("")).alias("model"),
            F.expr("CASE WHEN created > 10000000000 THEN created div 1000 ELSE created END").alias("timestamp"),
            split["input"].alias("input_tokens"),
            first_number(info, ["$.completionTokens", "$.completion_tokens"]).alias("output_tokens"),
            F.lit(0).cast("long").alias("cache_create_tokens"),
            split["cache_read"].alias("cache_read_tokens"),
        ),
        tool,
    )


def transcript_sessions(spark: SparkSession, path: str | Sequence[str], tool: str = "reasonix") -> DataFrame:
    """Sessions without requests: counts from a telemetry sidecar, else from a metadata one, else from assistant lines."""
    at = lines(spark, path, least_bytes=1)
    own = at.groupBy(file_stem(F.col("path")).alias("session_id")).agg(F.count_if(_json("$.role") == "assistant").alias("_lines"), F.max("modified").alias("last_modified"))
    side = documents(spark, path, glob="*.json").withColumn("session_id", F.regexp_extract("path", r"([^/]+?)\.(?:telemetry|meta)\.json$", 1))
    keys = {"input_tokens": ["$.inputTokens", "$.input_tokens"], "output_tokens": ["$.outputTokens", "$.output_tokens"], "cache_read_tokens": ["$.cacheReadTokens", "$.cache_read_tokens"], "_requests": ["$.requests", "$.turnCount"]}

    def sidecar(kind: str) -> DataFrame:
        body = F.first("body", ignorenulls=True)
        return side.where(F.col("path").endswith(f".{kind}.json")).groupBy("session_id").agg(body.alias(f"_{kind}"))

    joined = own.join(sidecar("telemetry"), "session_id", "left").join(sidecar("meta"), "session_id", "left")
    number = {n: F.coalesce(first_number(F.col("_telemetry"), k), first_number(F.col("_meta"), k)) for n, k in keys.items()}
    return joined.select(
        "session_id",
        F.lit(tool).alias("tool"),
        F.coalesce(F.get_json_object("_meta", "$.workspace"), F.get_json_object("_meta", "$.cwd")).alias("cwd"),
        F.get_json_object("_meta", "$.name").alias("project_name"),
        F.coalesce(number["_requests"], F.col("_lines")).alias("request_count"),
        *(F.coalesce(number[n], F.lit(0)).alias(n) for n in ("input_tokens", "output_tokens", "cache_read_tokens")),
        F.coalesce(F.get_json_object("_telemetry", "$.cost").try_cast("double"), F.get_json_object("_meta", "$.cost").try_cast("double")).alias("estimated_cost"),
        "last_modified",
    )


def folder_sessions(spark: SparkSession, path: str | Sequence[str], tool: str = "qoder_cli") -> DataFrame:
    """Sessions of line files that lie in a folder for each project: the working folder that a line states first, else the project that the folder's name stands for."""
    at = lines(spark, path).withColumns({"session_id": F.coalesce(_json("$.sessionId"), root_session(F.col("path"))), "_cwd": _json("$.cwd"), "_ts": first_time(F.col("line"), ["$.timestamp"])})
    stated = F.min(F.when(~is_blank(F.col("_cwd")), F.struct("path", "place", "_cwd")))["_cwd"]
    rolled = at.groupBy("session_id").agg(
        stated.alias("cwd"), F.min("path").alias("file_path"), F.min("_ts").alias("start_time"), F.max("_ts").alias("end_time"), F.max("modified").alias("last_modified"), F.count_if(F.coalesce(_json("$.role"), _json("$.type")) == "assistant").alias("request_count")
    )
    return rolled.select("session_id", F.lit(tool).alias("tool"), "cwd", F.coalesce(project_name(F.col("cwd")), folder_project(F.col("file_path"))).alias("project_name"), "file_path", "start_time", "end_time", "last_modified", "request_count")


def workspace_vote(paths: DataFrame, by: str = "session_id", path: str = "path", least_depth: int = 4) -> DataFrame:
    """(by, workspace): the folder most files lie under, of equal ones the deepest, then the smaller name."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    folders = paths.withColumn("_d", F.explode(F.sequence(F.lit(least_depth), F.greatest(F.size(parts) - 1, F.lit(least_depth))))).where(F.col("_d") < F.size(parts)).select(by, F.array_join(F.slice(parts, 1, F.col("_d")), "/").alias("workspace"), "_d")
    votes = folders.groupBy(by, "workspace", "_d").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(by).orderBy(F.desc("_n"), F.desc("_d"), "workspace")
    return votes.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(by, "workspace")
