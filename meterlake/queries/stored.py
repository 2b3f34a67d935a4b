"""Queries: streams, stored days, captured events, quotas and nested JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.keys import storage_key
from meterlake.functions.numbers import first_number, window_name
from meterlake.operators.quota import lowest_remaining, relay_tiers
from meterlake.operators import maintenance, statistics
from meterlake.plans import folders
from meterlake.plans.commands import Context, Usage
from meterlake.plans.inputs import FiledInput
from meterlake.plans.materialize import DayStore
from meterlake.plans.migrations import added, renamed, retyped
from meterlake.queries.bindings import _LOCAL, _PROXY, _SEEN_LOCALLY, AS_OF, BASE_CTE, END, METRICS_SQL, START, _columns, _duck, _events, facts, local, prices, proxy, read, remote, sessions
from meterlake.queries.registry import SQL, query, rounded
from meterlake.queries.reports import _WINDOWS, WINDOWS
from meterlake.sources.transcripts import nested_usage
from meterlake.streaming.capture import captured, folded, hourly_windows, largest_per_key, session_totals
from meterlake.streaming.ingest import RecordStore


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the warehouse, which a cluster shares; it goes when the application ends."""
    held = folders.gone_at_exit(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_meterlake/{uuid.uuid4().hex}")
    return f"{held}/{name}"


_ROUND = "CAST(min_ttft_ms AS DOUBLE) AS min_ttft_ms, CAST(max_ttft_ms AS DOUBLE) AS max_ttft_ms, round(cost + 1e-9, 4) AS cost, round(rate_sum, 4) AS rate_sum, round(min_rate, 4) AS min_rate, round(max_rate, 4) AS max_rate"


@query(BASE_CTE + f"SELECT * EXCLUDE (cost, rate_sum, min_rate, max_rate, min_ttft_ms, max_ttft_ms), {_ROUND} FROM (SELECT strftime(make_timestamp(timestamp_sec * 1000000), '%Y-%m-%d') AS local_date, model, {METRICS_SQL} FROM facts GROUP BY ALL)")
def materialized_model_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished days from the store, the last one live: as if all were computed at once."""
    usage, c = _stored_usage(spark, sf_dir)
    days = usage.daily_models(c).drop("status_counts")
    return rounded(days.withColumns({c: F.col(c).cast("double") for c in ("min_ttft_ms", "max_ttft_ms")}))


def _stored_usage(spark: SparkSession, sf_dir: str) -> tuple[Usage, Context]:
    """All finished days in a new store."""
    usage, c = Usage(proxy(spark, sf_dir), local(spark, sf_dir), sessions(spark, sf_dir), prices(spark), remote(spark, sf_dir), DayStore(spark, _folder(spark, "days"))), Context(AS_OF)
    usage.refresh_store(c)
    return usage, c


@query(BASE_CTE + "SELECT strftime(make_timestamp(timestamp_sec * 1000000), '%Y-%m-%d') AS local_date, model, CAST(status_code AS INTEGER) AS status_code, CAST(sum(request_count) AS BIGINT) AS requests FROM facts WHERE status_code IS NOT NULL GROUP BY ALL")
def materialized_status_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each day and model by status, out of the map that is kept."""
    usage, c = _stored_usage(spark, sf_dir)
    return usage.daily_models(c).select("local_date", "model", F.explode("status_counts").alias("status_code", "requests"))


#: Transcript rows that may be a day late, of which some vanish.
_LATE, _STAYS = "event_id % 4 * 30000", f"({_SEEN_LOCALLY}) AND event_id % 17 <> 0"
_LATE_CTE = BASE_CTE.replace(f"{_duck(_LOCAL.format(div='//', late=0))} FROM ev WHERE {_SEEN_LOCALLY}", f"{_duck(_LOCAL.format(div='//', late=_LATE))} FROM ev WHERE {_STAYS}")


@query(_LATE_CTE + "SELECT strftime(make_timestamp(timestamp_sec * 1000000), '%Y-%m-%d') AS local_date, coverage_origin, count(*) AS facts, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(timestamp_ms % 1000000) AS BIGINT) AS times FROM facts GROUP BY ALL")
def late_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days stored when half of the transcripts were there, and refreshed when the others had come and some had gone: most rows lie on another day than their record."""
    told = _events(spark, sf_dir).where(_SEEN_LOCALLY).selectExpr(*_columns(_LOCAL.format(div="div", late=_LATE)))
    store, c = DayStore(spark, _folder(spark, "days")), Context(AS_OF)
    for rows in (told.where("event_id % 2 = 0"), told.where("event_id % 17 <> 0")):
        usage = Usage(proxy(spark, sf_dir), rows, sessions(spark, sf_dir), prices(spark), remote(spark, sf_dir), store)
        usage.refresh_store(c)
    found = usage.facts(c).groupBy(F.timestamp_seconds("timestamp_sec").cast("date").cast("string").alias("local_date"), "coverage_origin")
    return found.agg(F.count("*").alias("facts"), F.sum("total_tokens").alias("total_tokens"), F.sum(F.col("timestamp_ms") % 1_000_000).alias("times"))


def _by_day(rows: DataFrame, seconds: Column) -> DataFrame:
    """Rows of a day brought together, for files of whole days or, of large ones, of parts of a day: their number grows with the rows."""
    return rows.withColumn("_day", F.timestamp_seconds(seconds).cast("date")).hint("rebalance", F.col("_day")).drop("_day")


@query(SQL["late_transcripts"])
def late_transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from files: some come, some go, and the second refresh opens the new ones and those of the days that they reach."""
    at, c = _folder(spark, "files"), Context(AS_OF)
    told = _events(spark, sf_dir).where(_SEEN_LOCALLY).selectExpr(*_columns(_LOCAL.format(div="div", late=_LATE)))
    times = {"proxy": F.expr("timestamp div 1000"), "local": F.col("timestamp"), "remote": F.col("timestamp")}
    for side, rows in {"proxy/all": proxy(spark, sf_dir), "remote/all": remote(spark, sf_dir), "local/stay": told.where("event_id % 2 = 0 AND event_id % 17 <> 0"), "local/go": told.where("event_id % 34 = 0")}.items():
        _by_day(rows, times[side.split("/")[0]]).write.parquet(f"{at}/{side}")
    files = {side: FiledInput(spark, f"{at}/index/{side}", [f"{at}/{side}"], lambda paths: spark.read.parquet(*paths), seconds) for side, seconds in times.items()}
    store = DayStore(spark, f"{at}/days")
    Usage.of_files(files, sessions(spark, sf_dir), prices(spark), store).refresh_store(c)
    folders.remove(spark, f"{at}/local/go")
    _by_day(told.where("event_id % 2 = 1 AND event_id % 17 <> 0"), times["local"]).write.parquet(f"{at}/local/come")
    usage = Usage.of_files(files, sessions(spark, sf_dir), prices(spark), store)
    usage.refresh_store(c)
    found = usage.facts(c).groupBy(F.timestamp_seconds("timestamp_sec").cast("date").cast("string").alias("local_date"), "coverage_origin")
    return found.agg(F.count("*").alias("facts"), F.sum("total_tokens").alias("total_tokens"), F.sum(F.col("timestamp_ms") % 1_000_000).alias("times"))


@query(SQL["window_usage"])
def window_usage_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows from stored days, the facts of the days that they begin in, and the live day."""
    usage, c = _stored_usage(spark, sf_dir)
    return rounded(usage.refresh_bundle(c)["windows"])


@query(BASE_CTE + f", w(win, since) AS (VALUES {_WINDOWS}) SELECT win AS \"window\", model, CAST(sum(request_count) AS BIGINT) AS requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(estimated_cost) + 1e-9, 4) AS cost FROM w JOIN facts ON timestamp_sec >= since AND timestamp_sec <= {AS_OF} GROUP BY ALL")
def window_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.window_models(statistics.windowed(facts(spark, sf_dir).where(F.col("timestamp_sec") <= AS_OF), WINDOWS)))


@query(BASE_CTE + f"SELECT count(*) AS requests, CAST(sum(input_tokens + output_tokens + cache_create_tokens + cache_read_tokens) AS BIGINT) AS total_tokens, round(sum(estimated_cost) + 1e-9, 4) AS cost, count(*) FILTER (status_code < 300) AS visible_requests, CAST(sum(input_tokens + output_tokens + cache_create_tokens + cache_read_tokens) FILTER (status_code < 300) AS BIGINT) AS visible_total_tokens, round(sum(estimated_cost) FILTER (status_code < 300) + 1e-9, 4) AS visible_cost FROM proxy WHERE timestamp >= {START * 1000} AND timestamp < {END * 1000}")
def proxy_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of the proxy's records with errors and without."""
    return rounded(statistics.window_requests(proxy(spark, sf_dir), START * 1000, END * 1000))


@query(BASE_CTE + f"SELECT timestamp_sec, tool, model, status_code, input_tokens FROM facts WHERE timestamp_sec >= {START} AND timestamp_sec < {END}")
def facts_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a week, ordered by time, out of stored days."""
    usage, c = _stored_usage(spark, sf_dir)
    return usage.timeline(c, START, END).select("timestamp_sec", "tool", "model", "status_code", "input_tokens")


#: Shapes of stored facts: tools had another name, then statuses were texts, then facts had no weight.
_SHAPES = {"facts": (renamed(1, "client", "tool"), retyped(2, "status_code", "int"), added(3, "request_count", "long", 1))}


def _as_of_old(spark: SparkSession, store: DayStore, path: str) -> DayStore:
    """A copy of a store as a version before all of ``_SHAPES`` would have left it."""
    for table in (t for t in ("daily", "cells", "seen", "links") if any(n.startswith("part=") for n in folders.children(spark, f"{store.path}/{t}"))):
        spark.read.parquet(f"{store.path}/{table}").write.partitionBy("part").parquet(f"{path}/{table}")
    first = spark.read.parquet(f"{store.path}/facts").withColumnRenamed("tool", "client").withColumn("status_code", F.col("status_code").cast("string")).drop("request_count")
    first.write.partitionBy("part").parquet(f"{path}/facts")
    store.state().drop("shape").coalesce(1).write.parquet(f"{path}/state/v={1:012d}")
    return DayStore(spark, path, migrations=_SHAPES)


@query(SQL["facts_in_time"])
def facts_of_older_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same out of a store whose first days an older version wrote; the days that a refresh has added are of today's shape."""
    sides, c = (proxy(spark, sf_dir), local(spark, sf_dir), remote(spark, sf_dir)), Context(AS_OF)
    early, until = DayStore(spark, _folder(spark, "early")), (START + END) // 2
    old = (rows.where(F.col("timestamp") < until * unit) for rows, unit in zip(sides, (1000, 1, 1), strict=True))
    p, mine, theirs = old
    Usage(p, mine, sessions(spark, sf_dir), prices(spark), theirs, early).refresh_store(c)
    store = _as_of_old(spark, early, _folder(spark, "days"))
    usage = Usage(sides[0], sides[1], sessions(spark, sf_dir), prices(spark), sides[2], store)
    usage.refresh_store(c)
    return usage.timeline(c, START, END).select("timestamp_sec", "tool", "model", "status_code", "input_tokens")


@query(BASE_CTE + "SELECT strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d') AS day, count(*) FILTER (device = 1) AS gone, count(*) FILTER (device <> 1) AS stay FROM (SELECT timestamp, event_id % 3 AS device FROM remote) GROUP BY 1 HAVING count(*) FILTER (device = 1) > 0")
def dropped_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that a device's rows leave, with what goes and what stays on them."""
    day = F.timestamp_seconds("timestamp").cast("date").cast("string")
    rows = remote(spark, sf_dir).withColumn("device_id", (F.col("event_id") % 3).cast("string"))
    kept, days = maintenance.without_device(rows, "1", day)
    before, after = (d.groupBy(day.alias("day")).agg(F.count("*").alias(n)) for d, n in ((rows, "all"), (kept, "stay")))
    left = days.join(before, "day").join(after, "day", "left").withColumn("stay", F.coalesce("stay", F.lit(0)))
    return left.select("day", (F.col("all") - F.col("stay")).alias("gone"), "stay")


@query(BASE_CTE + "SELECT tool, CAST(sum(request_count) AS BIGINT) AS requests, CASE tool WHEN 'codex' THEN 'Codex CLI' ELSE tool END AS label, CASE tool WHEN 'codex' THEN 'icon-c' WHEN 'qoder_ide' THEN 'icon-q' END AS icon FROM facts GROUP BY tool")
def tools_with_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = spark.createDataFrame([("codex", "Codex CLI", "icon-c"), ("qoder_ide", None, "icon-q"), ("unused", "Unused", None)], "tool string, display_name string, icon string")
    return statistics.with_tool_profile(statistics.ranking(facts(spark, sf_dir), "tool"), profiles).select("tool", "requests", "label", "icon")


@query(BASE_CTE + "SELECT client_tool, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, min(timestamp) AS first_ms, max(timestamp) AS last_ms FROM proxy GROUP BY 1")
def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that arrive as two streams, smaller ones a day later first, end up in the store once, on the larger one's day."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ev = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").where("event_id % 5 <> 0")
    own = ev.select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("kk"), F.floor("value").cast("long").alias("v"), F.expr("CASE user_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' WHEN 2 THEN 'qoder_ide' ELSE 'qoder_cli' END").alias("tool"))
    rows, none = own.selectExpr(*_columns(_PROXY)), F.lit(0)
    keyed = rows.withColumn("storage_dedupe_key", storage_key(F.col("client_tool"), F.col("message_id"), F.col("session_id"), F.col("request_start_time"), F.col("timestamp"), F.col("model"), none))
    smaller = keyed.withColumns({"input_tokens": F.greatest(F.col("input_tokens") - 1, F.lit(0)), "timestamp": F.col("timestamp") + 86_400_000})
    folder = _folder(spark, "records")
    store = RecordStore(spark, folder)
    for i, stream in enumerate((smaller, keyed)):
        store.start(stream, f"{folder}__checkpoint_{i}").awaitTermination()
    return store.read().groupBy("client_tool").agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


@query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS input_tokens FROM lineitem GROUP BY ALL")
def largest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of records of one key the one of most tokens stays."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("input_tokens"), *(F.lit(0).cast("long").alias(c) for c in ("output_tokens", "cache_create_tokens", "cache_read_tokens")), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("timestamp"))
    return largest_per_key(li.withColumn("storage_dedupe_key", F.concat_ws(":", "l_orderkey", "l_linenumber"))).select("l_orderkey", "l_linenumber", "input_tokens")


@query(BASE_CTE + "SELECT session_id, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_create_tokens) AS BIGINT) AS cache_create_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, min(timestamp) AS first_ms, max(timestamp) AS last_ms FROM proxy GROUP BY session_id")
def session_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_totals(proxy(spark, sf_dir))


_SSE = """
WITH t AS (SELECT conv_id, turn, length(text) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS request_id, concat('msg_', conv_id) AS message_id, 'm-1' AS model, max(n) FILTER (turn = 0) AS input_tokens, CAST(arg_max(n, turn) FILTER (turn > 0 OR last = 0) AS BIGINT) AS output_tokens, CAST(max(n % 9) FILTER (turn = 0) AS BIGINT) AS cache_read_tokens, max(turn) * 1000 AS duration_ms, CAST(coalesce(min(turn) FILTER (turn % 3 = 1), 0) * 1000 AS BIGINT) AS first_ms FROM t GROUP BY conv_id
"""


_SSE = _SSE.replace("arg_max(n, turn) FILTER (turn > 0 OR last = 0)", "coalesce(arg_max(n, turn) FILTER (turn > 0 AND turn % 3 <> 1), 0)")


def _as_events(conversations: DataFrame, began_ms: int) -> DataFrame:
    """Conversations as event streams: the opening message, deltas of text, and counts that grow."""
    c = conversations.select("conv_id", F.col("turn").alias("seq"), F.length("text").alias("n"))
    opening = F.format_string('{"type":"message_start","message":{"id":"msg_%d","model":"m-1","usage":{"input_tokens":%d,"cache_read_input_tokens":%d}}}', "conv_id", "n", F.col("n") % 9)
    text = F.lit('{"type":"content_block_delta","delta":{"text":"x"}}')
    counts = F.format_string('{"type":"message_delta","usage":{"output_tokens":%d}}', "n")
    data = F.when(F.col("seq") == 0, opening).when(F.col("seq") % 3 == 1, text).otherwise(counts)
    return c.select(F.col("conv_id").cast("string").alias("request_id"), "seq", (F.col("seq") * 1000 + began_ms).alias("ts_ms"), data.alias("data"))


def _shown_usage(records: DataFrame) -> DataFrame:
    return records.select("request_id", "message_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "duration_ms", F.coalesce("ttft_ms", F.lit(0)).cast("long").alias("first_ms"))


@query(_SSE)
def captured_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_usage(folded(_as_events(read(spark, sf_dir, "conversations"), 0)))


@query(_SSE)
def streamed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a stream that begins in the last second of a day: each response is one record, though it goes on after midnight."""
    midnight = START * 1000
    table = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/conversations.parquet").schema).parquet(f"{sf_dir}/conversation[s].parquet")
    events = _as_events(table, midnight - 1000)
    # an event of two days later moves the watermark past all others
    later = F.struct(F.lit("later").alias("request_id"), F.lit(0).cast("long").alias("seq"), F.lit(midnight + 172_800_000).alias("ts_ms"), F.lit("{}").alias("data"))
    own = F.struct("request_id", "seq", "ts_ms", "data")
    both = events.select(F.inline(F.when(F.col("seq") == 0, F.array(own, later)).otherwise(F.array(own))))
    folder = _folder(spark, "captured")
    captured(both).writeStream.format("parquet").option("path", f"{folder}/records").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _shown_usage(spark.read.parquet(f"{folder}/records").where("request_id <> 'later'"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS requests, CAST(sum(floor(value)) AS BIGINT) AS output_tokens FROM events GROUP BY 1")
def streamed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hours of a stream, each given out once the watermark has passed it."""
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    own = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.floor("value").cast("long").alias("output_tokens"))
    # an event of 40 days later moves the watermark past all others; its own hour stays open
    later = F.struct((own["timestamp"] + 40 * 86_400_000).alias("timestamp"), F.lit(None).cast("long").alias("output_tokens"))
    both = stream.select(F.inline(F.when(F.col("event_id") == 0, F.array(own, later)).otherwise(F.array(own))))
    folder = _folder(spark, "hours")
    hourly_windows(both).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/rows").where("output_tokens IS NOT NULL")
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "requests", "output_tokens")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A usage object at any depth of a JSON text."""
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"a": [1, {"b": '), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"c": {"input_tokens": '), k, F.lit("}}"))).otherwise(F.concat(F.lit('[[{"prompt_tokens": '), k, F.lit("}]]"))), F.lit("}]}"))
    found = read(spark, sf_dir, "events").select("event_id", nested_usage(doc).alias("u"))
    return found.select("event_id", first_number(F.col("u"), ["$.input_tokens", "$.prompt_tokens"]).alias("k"))


@query("SELECT o_orderkey, CASE s WHEN 18000 THEN 'five_hour' WHEN 604800 THEN 'seven_day' ELSE CASE WHEN s // 3600 >= 24 THEN concat(s // 3600 // 24, '_day') ELSE concat(s // 3600, '_hour') END END AS name FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 18000 WHEN 1 THEN 604800 ELSE o_custkey * 360 END AS s FROM orders)")
def window_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 18000 WHEN 1 THEN 604800 ELSE o_custkey * 360 END")
    return read(spark, sf_dir, "orders").select("o_orderkey", window_name(s).alias("name"))


#: What services answer, with an order's numbers: granted q, left r of it.
_BODY = {
    "kimi": '{"usage":{"limit":"%1$d","remaining":"%2$d"},"limits":[{"window":{"duration":300,"timeUnit":"TIME_UNIT_MINUTE"},"detail":{"limit":"%1$d","remaining":"%2$d"}}]}',
    "minimax": '{"model_remains":[{"model_name":"m","current_interval_total_count":%1$d,"current_interval_usage_count":%2$d}]}',
    "zenmux": '{"data":{"remaining":%2$d,"quota":%1$d}}',
    "deepseek": '{"balance_infos":[{"total_balance":"%2$d"}]}',
    "stepfun": '{"balance":%2$d}',
    "siliconflow": '{"data":{"totalBalance":"%2$d"}}',
    "openrouter": '{"data":{"total_credits":%1$d,"total_usage":%2$d}}',
    "novita": '{"availableBalance":"%2$d"}',
    "zhipu": '{"data":{"limits":[{"type":"TOKENS_LIMIT","percentage":%2$d}]}}',
    "other": "not json %1$d %2$d",
}
_QUOTA = "SELECT o_orderkey, o_orderkey % 10 AS k, o_custkey + 100 AS q, o_orderkey % 100 AS r FROM orders"
_LEFT = "100.0 * (q - r) / q AS utilization, q - r AS used, q AS quota"


@query(f"""
WITH o AS ({_QUOTA})
SELECT o_orderkey, provider, name, round(CAST(utilization AS DOUBLE) + 1e-9, 4) AS utilization, CAST(used AS DOUBLE) AS used, CAST(quota AS DOUBLE) AS quota FROM (
  SELECT o_orderkey, 'kimi' AS provider, unnest(['five_hour', 'weekly_limit']) AS name, {_LEFT} FROM o WHERE k = 0
  UNION ALL SELECT o_orderkey, 'minimax', 'm', 100.0 * r / q, r, q FROM o WHERE k = 1
  UNION ALL SELECT o_orderkey, 'zenmux', 'balance', {_LEFT} FROM o WHERE k = 2
  UNION ALL SELECT o_orderkey, ['deepseek', 'stepfun', 'siliconflow', '', 'novita'][k - 2], 'balance', 0, 0, r FROM o WHERE k IN (3, 4, 5, 7)
  UNION ALL SELECT o_orderkey, 'openrouter', 'balance', 100.0 * r / q, r, q FROM o WHERE k = 6
  UNION ALL SELECT o_orderkey, 'zhipu', 'TOKENS_LIMIT', r, r, 100 FROM o WHERE k = 8
)""")
def relay_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("k"), (F.col("o_custkey") + 100).alias("q"), (F.col("o_orderkey") % 100).alias("r"))
    kinds = [(F.lit(name), F.format_string(body, "q", "r")) for name, body in _BODY.items()]
    name, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (provider, body) in enumerate(kinds):
        name, text = F.when(F.col("k") == i, provider).otherwise(name), F.when(F.col("k") == i, body).otherwise(text)
    bodies = o.select("o_orderkey", name.alias("provider"), text.alias("body"))
    tiers = bodies.select("o_orderkey", "provider", F.explode(relay_tiers(F.col("provider"), F.col("body"))).alias("t"))
    return rounded(tiers.select("o_orderkey", "provider", "t.name", "t.utilization", "t.used", "t.quota"))


@query("SELECT family, arg_min(model, (f, model)) AS model, round(min(f), 6) AS remaining_fraction, round(100 * (1 - min(f)), 4) AS utilization FROM (SELECT p_name AS model, p_size / 100.0 AS f, CASE WHEN contains(p_name, 'large') THEN 'x-flash-lite' WHEN contains(p_name, 'small') THEN 'x-flash' ELSE 'x-pro' END AS m, CASE WHEN contains(p_name, 'large') THEN 'flash_lite' WHEN contains(p_name, 'small') THEN 'flash' ELSE 'pro' END AS family FROM part) GROUP BY family")
def lowest_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of model families: the least left counts."""
    named = read(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_name").contains("large"), "flash-lite ").when(F.col("p_name").contains("small"), "flash ").otherwise("pro "), F.col("p_name")).alias("model"), (F.col("p_size") / 100.0).alias("remaining_fraction"), F.lit(None).cast("string").alias("resets_at"))
    return lowest_remaining(named).select("family", F.regexp_replace("model", r"^\S+ ", "").alias("model"), F.round("remaining_fraction", 6).alias("remaining_fraction"), F.round("utilization", 4).alias("utilization"))
