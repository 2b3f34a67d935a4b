"""The supplied tables read as usage telemetry, and the same projections as SQL.

``events`` plays both observers: the proxy misses every fifth event, the transcripts every third but for those that the
proxy misses too, so that all kinds of coverage occur and every event is seen by one of them. ``customer`` and ``orders`` play sessions and projects, ``conversations`` transcripts.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators.merge import merge_facts
from meterlake.plans.commands import Usage
from meterlake.schemas import PRICES

#: The moment that reports look back from, and a range of days.
AS_OF = int(datetime(2024, 1, 30, 18, 0, tzinfo=UTC).timestamp())
START, END = (int(datetime(2024, 1, d, tzinfo=UTC).timestamp()) for d in (5, 12))

PRICE_ROWS = [
    ("view", "View", 3.0, 15.0, 0.3, 3.75, "api", 1, 0),
    ("VIEW", "Loud view", 9.0, 9.0, None, None, "api", 2, 1),
    ("cli", "Short", 1.0, 2.0, None, 1.25, "api", 1, 2),
    ("click", "Click", 0.8, 4.0, None, None, "custom", 1, 3),
    ("pur-chase", "Purchase", 2.5, 10.0, 0.25, None, "api", 1, 4),
    ("error", "Error", 5.0, 25.0, 0.5, 6.25, "api", 1, 5),
    ("error", "Own error", 4.0, 20.0, None, None, "custom", 1, 6),
]
SOURCES = [
    {"id": "src-a", "display_name": "Alpha", "api_key_prefixes": ["sk-0", "sk-1"], "base_url": None, "rank": 0},
    {"id": "src-b", "display_name": None, "api_key_prefixes": ["sk-2", "sk-1"], "base_url": "https://api1.example.com/v1", "rank": 1},
    {"id": "src-c", "display_name": "Gamma", "api_key_prefixes": ["sk-2"], "base_url": "https://api1.example.com/v1", "rank": 2},
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.get_json_object("props", "$.k").cast("long").alias("kk"),
        F.floor("value").cast("long").alias("v"),
        F.expr("CASE user_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' WHEN 2 THEN 'qoder_ide' ELSE 'qoder_cli' END").alias("tool"),
    )


_PROXY = """
  ms AS timestamp, CAST(event_id AS STRING) AS message_id, CAST(NULL AS STRING) AS canonical_request_key, kk * 10 AS input_tokens, v AS output_tokens,
  kk % 7 AS cache_create_tokens, CASE WHEN event_id % 4 = 0 THEN kk * 3 ELSE 0 END AS cache_read_tokens,
  CASE WHEN event_type = 'signup' THEN 'unknown' ELSE event_type END AS model, CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('s', CAST(user_id AS STRING)) END AS session_id,
  ms - (kk * 10 + 1) AS request_start_time, ms AS request_end_time, kk * 10 + 1 AS duration_ms, v / ((kk * 10 + 1) / 1000.0E0) AS output_tokens_per_second,
  CASE WHEN event_id % 3 = 0 THEN kk * 3 END AS ttft_ms,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 97 = 0 THEN 302 WHEN event_id % 31 = 0 THEN 404 ELSE 200 END AS status_code,
  (kk * 30 + v * 15) / 1000000.0E0 AS estimated_cost, event_id % 4 <> 1 AS cost_locked,
  CASE WHEN event_id % 13 <> 0 THEN concat('sk-', CAST(user_id % 5 AS STRING)) END AS api_key_prefix,
  CASE WHEN user_id % 3 <> 0 THEN concat('https://api', CAST(user_id % 3 AS STRING), '.example.com/v1') END AS request_base_url, tool AS client_tool, event_id
"""
_LOCAL = """
  concat('s', CAST(user_id AS STRING)) AS session_id, tool, CAST(event_id AS STRING) AS message_id, CAST(NULL AS STRING) AS request_key, ms {div} 1000 + event_id % 3 + {late} AS timestamp,
  CASE WHEN event_type = 'purchase' THEN 'Purchase-20240101' ELSE event_type END AS model, kk * 10 + event_id % 2 AS input_tokens, v + 1 AS output_tokens, event_id % 5 AS cache_create_tokens,
  CASE WHEN event_id % 6 = 0 THEN 0 ELSE kk END AS cache_read_tokens, kk * 10 + event_id % 2 + v + 1 + event_id % 5 + CASE WHEN event_id % 6 = 0 THEN 0 ELSE kk END AS total_tokens,
  CASE WHEN event_id % 50 = 0 THEN 7 ELSE 1 END AS request_count, CASE WHEN event_id % 10 = 0 THEN 0.01E0 END AS explicit_estimated_cost, event_id
"""


_SEEN_LOCALLY = "event_id % 3 <> 0 OR event_id % 5 = 0"


def _columns(text: str) -> list[str]:
    """Top-level items of a select list."""
    out, depth, item = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item.strip())
            item = ""
        else:
            item += c
    return [*out, item.strip()]


def proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_id % 5 <> 0").selectExpr(*_columns(_PROXY))


def local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where(_SEEN_LOCALLY).selectExpr(*_columns(_LOCAL.format(div="div", late=0)))


def remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_id % 7 = 0").selectExpr(*_columns(_LOCAL.format(div="div", late=100)))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(*_columns(_SESSIONS.format(models="array('view', c_mktsegment)")))


_SESSIONS = """
  concat('s', CAST(c_custkey AS STRING)) AS session_id, CASE c_custkey % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' WHEN 2 THEN 'qoder_ide' ELSE 'qoder_cli' END AS tool,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('/home/u/', CAST(c_nationkey AS STRING), '/', c_mktsegment) END AS cwd,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS project_name, CAST(NULL AS STRING) AS file_path, {models} AS models,
  1704067200 + c_custkey * 600 AS start_time, 1704067200 + c_custkey * 600 + 7200 AS end_time, 1704067200 + c_custkey * 600 + 7300 AS last_modified,
  c_custkey % 9 AS request_count, c_custkey * 3 AS input_tokens, c_custkey AS output_tokens, c_custkey * 0 AS cache_create_tokens, c_custkey % 10 AS cache_read_tokens, CAST(NULL AS DOUBLE) AS estimated_cost
"""


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICE_ROWS, PRICES)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "id string, display_name string, api_key_prefixes array<string>, base_url string, rank int")


def facts(spark: SparkSession, sf_dir: str, include_errors: bool = True) -> DataFrame:
    return merge_facts(proxy(spark, sf_dir), local(spark, sf_dir), remote(spark, sf_dir), sessions(spark, sf_dir), prices(spark), include_errors)


def usage(spark: SparkSession, sf_dir: str) -> Usage:
    """The reports' view of the same observations, without stored days."""
    return Usage(proxy(spark, sf_dir), local(spark, sf_dir), sessions(spark, sf_dir), prices(spark), remote(spark, sf_dir))


def _duck(text: str) -> str:
    """DuckDB divides whole numbers by ``//``, and decimals literals are made doubles."""
    return text.replace("STRING", "VARCHAR").replace("1000.0E0", "CAST(1000 AS DOUBLE)").replace("1000000.0E0", "CAST(1000000 AS DOUBLE)").replace("0.01E0", "CAST(0.01 AS DOUBLE)")


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS {'DOUBLE' if isinstance(x, float) else 'INTEGER'})"


PRICES_CTE = "prices(model_id, display_name, input_price, output_price, cache_read_price, cache_write_price, source, last_updated, rank) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in PRICE_ROWS) + ")"

BASE_CTE = f"""
WITH ev AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kk, CAST(floor(value) AS BIGINT) AS v,
    CASE user_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' WHEN 2 THEN 'qoder_ide' ELSE 'qoder_cli' END AS tool
  FROM events
), proxy AS (SELECT {_duck(_PROXY)} FROM ev WHERE event_id % 5 <> 0),
local AS (SELECT {_duck(_LOCAL.format(div="//", late=0))} FROM ev WHERE {_SEEN_LOCALLY}),
remote AS (SELECT {_duck(_LOCAL.format(div="//", late=100))} FROM ev WHERE event_id % 7 = 0),
sessions AS (SELECT {_duck(_SESSIONS.format(models="['view', c_mktsegment]"))} FROM customer),
{PRICES_CTE},
best AS (
  SELECT model, arg_min(struct_pack(i := input_price, o := output_price, r := coalesce(cache_read_price, input_price * 0.1), w := coalesce(cache_write_price, 0), id := model_id),
    score * 1000 + CASE source WHEN 'custom' THEN 0 ELSE 100 END + rank) AS p
  FROM (
    SELECT m.model, prices.*, CASE WHEN model = model_id THEN 0 WHEN lower(model) = lower(model_id) THEN 1
      WHEN contains(lower(model), lower(model_id)) OR contains(lower(model_id), lower(model)) THEN 2
      WHEN contains(nm, np) OR contains(np, nm) THEN 3 END AS score
    FROM (SELECT DISTINCT model, lower(regexp_replace(model, '[^A-Za-z0-9]', '', 'g')) AS nm FROM (SELECT model FROM local UNION SELECT model FROM remote)) m,
      (SELECT *, lower(regexp_replace(model_id, '[^A-Za-z0-9]', '', 'g')) AS np FROM prices) prices
  ) WHERE score IS NOT NULL GROUP BY model
), pk AS (
  SELECT *, CASE WHEN trim(message_id) = '' THEN '' ELSE concat(client_tool, ':', message_id) END AS k FROM proxy
), lk AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT *, concat(tool, ':', message_id) AS k, row_number() OVER (PARTITION BY concat(tool, ':', message_id) ORDER BY origin, timestamp) AS n
    FROM (SELECT *, 0 AS origin FROM local UNION ALL SELECT *, 1 AS origin FROM remote)
  ) WHERE n = 1
), merged AS (
  SELECT coalesce(p.k, l.k) AS canonical_request_key,
    CASE WHEN l.k IS NOT NULL AND l.session_id <> '' THEN l.session_id WHEN p.session_id <> '' THEN p.session_id ELSE coalesce(m.session_id, p.session_id) END AS session_id,
    coalesce(l.tool, p.client_tool) AS tool,
    CASE WHEN p.k IS NOT NULL THEN p.model ELSE l.model END AS raw_model,
    CASE WHEN p.k IS NULL THEN l.input_tokens WHEN l.k IS NULL OR p.input_tokens > 0 THEN p.input_tokens ELSE l.input_tokens END AS input_tokens,
    CASE WHEN p.k IS NULL THEN l.output_tokens WHEN l.k IS NULL OR p.output_tokens > 0 THEN p.output_tokens ELSE l.output_tokens END AS output_tokens,
    CASE WHEN l.k IS NULL THEN p.cache_create_tokens WHEN p.k IS NULL OR l.cache_create_tokens > 0 THEN l.cache_create_tokens ELSE p.cache_create_tokens END AS cache_create_tokens,
    CASE WHEN l.k IS NULL THEN p.cache_read_tokens WHEN p.k IS NULL OR l.cache_read_tokens > 0 THEN l.cache_read_tokens ELSE p.cache_read_tokens END AS cache_read_tokens,
    coalesce(l.timestamp, p.timestamp // 1000) AS timestamp_sec, coalesce(p.timestamp, l.timestamp * 1000) AS timestamp_ms,
    CAST(coalesce(greatest(l.request_count, 1), 1) AS BIGINT) AS request_count,
    CASE WHEN p.k IS NOT NULL AND (l.k IS NULL OR p.cost_locked) THEN p.estimated_cost
      ELSE coalesce(l.explicit_estimated_cost, (l.input_tokens * b.p.i + l.output_tokens * b.p.o + l.cache_create_tokens * b.p.w + l.cache_read_tokens * b.p.r) / CAST(1000000 AS DOUBLE), 0) END AS estimated_cost,
    CASE WHEN l.k IS NULL THEN 'proxy_only' WHEN p.k IS NULL THEN 'local_only' ELSE 'merged_proxy_preferred' END AS coverage_origin,
    CASE WHEN p.k IS NULL THEN 200 ELSE p.status_code END AS status_code, p.duration_ms, p.output_tokens_per_second, p.ttft_ms, p.api_key_prefix, p.request_base_url, p.k IS NOT NULL AS seen
  FROM pk p FULL OUTER JOIN lk l ON p.k = l.k LEFT JOIN best b ON b.model = l.model LEFT JOIN (SELECT message_id, arg_max(session_id, struct_pack(t := timestamp, s := session_id)) AS session_id FROM local GROUP BY 1) m ON m.message_id = p.message_id
), facts AS (
  SELECT m.* EXCLUDE (raw_model, seen), coalesce(m.input_tokens + m.output_tokens + m.cache_create_tokens + m.cache_read_tokens, 0) AS total_tokens,
    CASE WHEN lower(trim(raw_model)) IN ('', 'unknown', 'custom_model') THEN CASE m.tool WHEN 'qoder_ide' THEN 'Qoder IDE' WHEN 'qoder_cli' THEN 'Qoder CLI' ELSE 'unknown' END ELSE trim(raw_model) END AS model,
    coalesce(api_key_prefix, request_base_url) AS source_label, s.project_name, s.cwd AS project_path
  FROM merged m LEFT JOIN sessions s ON s.session_id = m.session_id
)
"""

#: The universal aggregate over facts
METRICS_SQL = """
  CAST(sum(request_count) AS BIGINT) AS requests,
  CAST(coalesce(sum(request_count) FILTER (coverage_origin = 'local_only'), 0) AS BIGINT) AS local_requests,
  CAST(coalesce(sum(request_count) FILTER (coverage_origin <> 'local_only'), 0) AS BIGINT) AS proxy_requests,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cache_create_tokens) AS BIGINT) AS cache_create_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(estimated_cost) AS cost, count(status_code) AS status_facts,
  CAST(coalesce(sum(request_count) FILTER (status_code BETWEEN 200 AND 299), 0) AS BIGINT) AS success_requests,
  CAST(coalesce(sum(request_count) FILTER (status_code BETWEEN 400 AND 499), 0) AS BIGINT) AS client_errors,
  CAST(coalesce(sum(request_count) FILTER (status_code >= 500), 0) AS BIGINT) AS server_errors,
  coalesce(sum(output_tokens_per_second) FILTER (duration_ms > 0 AND output_tokens_per_second > 0), 0) AS rate_sum,
  count(*) FILTER (duration_ms > 0 AND output_tokens_per_second > 0) AS rate_count,
  CAST(coalesce(sum(output_tokens) FILTER (duration_ms > 0 AND output_tokens_per_second > 0), 0) AS BIGINT) AS rate_tokens,
  CAST(coalesce(sum(duration_ms) FILTER (duration_ms > 0 AND output_tokens_per_second > 0), 0) AS BIGINT) AS rate_ms,
  min(output_tokens_per_second) FILTER (duration_ms > 0 AND output_tokens_per_second > 0) AS min_rate,
  max(output_tokens_per_second) FILTER (duration_ms > 0 AND output_tokens_per_second > 0) AS max_rate,
  CAST(coalesce(sum(ttft_ms) FILTER (ttft_ms > 0), 0) AS BIGINT) AS ttft_sum, count(*) FILTER (ttft_ms > 0) AS ttft_count,
  min(ttft_ms) FILTER (ttft_ms > 0) AS min_ttft_ms, max(ttft_ms) FILTER (ttft_ms > 0) AS max_ttft_ms, max(timestamp_ms) AS last_seen_ms
"""
