"""Queries: merge, metrics, statistics, rankings and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import calendar as cal
from meterlake.operators import metrics, statistics
from meterlake.plans.commands import Context
from meterlake.queries.bindings import AS_OF, BASE_CTE, END, METRICS_SQL, START, facts, sources, usage
from meterlake.queries.registry import query, rounded

_FACTS = "canonical_request_key, session_id, project_name, project_path, api_key_prefix, request_base_url, source_label, tool, timestamp_sec, timestamp_ms, model, input_tokens, output_tokens, cache_create_tokens, cache_read_tokens, total_tokens, request_count, round(estimated_cost + 1e-9, 6) AS estimated_cost, coverage_origin, status_code, CAST(duration_ms AS DOUBLE) AS duration_ms, round(output_tokens_per_second, 4) AS output_tokens_per_second, CAST(ttft_ms AS DOUBLE) AS ttft_ms"
_RANGE = f"timestamp_sec >= {START} AND timestamp_sec < {END}"
_ROUND = "CAST(min_ttft_ms AS DOUBLE) AS min_ttft_ms, CAST(max_ttft_ms AS DOUBLE) AS max_ttft_ms, round(cost + 1e-9, 4) AS cost, round(rate_sum, 4) AS rate_sum, round(min_rate, 4) AS min_rate, round(max_rate, 4) AS max_rate"
_M = "EXCLUDE (cost, rate_sum, min_rate, max_rate, min_ttft_ms, max_ttft_ms)"


def _shown(rows: DataFrame) -> DataFrame:
    """Rounded, and times that may be missing as doubles, which have one form of missing everywhere."""
    return rows.withColumns({"estimated_cost": F.round(F.col("estimated_cost") + 1e-9, 6), "output_tokens_per_second": F.round("output_tokens_per_second", 4)} | {c: F.col(c).cast("double") for c in ("duration_ms", "ttft_ms")})


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in ("min_ttft_ms", "max_ttft_ms")})


def in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).where(_RANGE)


@query(BASE_CTE + f"SELECT {_FACTS} FROM facts")
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(facts(spark, sf_dir))


@query(BASE_CTE + f"SELECT {_FACTS} FROM facts WHERE coverage_origin = 'local_only' OR status_code BETWEEN 200 AND 299")
def merged_facts_without_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(facts(spark, sf_dir, include_errors=False))


@query(BASE_CTE + f"SELECT * {_M}, {_ROUND} FROM (SELECT model, coverage_origin, {METRICS_SQL} FROM facts GROUP BY ALL)")
def metrics_by_model_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_timed(metrics.measured(facts(spark, sf_dir), "model", "coverage_origin")))


@query(BASE_CTE + f"SELECT * {_M}, {_ROUND} FROM (SELECT tool, {METRICS_SQL} FROM facts GROUP BY ALL)")
def metrics_of_daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial metrics of each day add up to the whole."""
    daily = metrics.measured(facts(spark, sf_dir).withColumn("day", cal.business_date(F.col("timestamp_sec"))), "day", "tool")
    return rounded(_timed(metrics.remeasured(daily, "tool")))


_TOTALS = "requests, local_requests, proxy_requests, total_tokens, input_tokens, output_tokens, cache_create_tokens, cache_read_tokens, round(cost + 1e-9, 4) AS cost, success_requests, client_errors + server_errors AS error_requests"


@query(BASE_CTE + f"SELECT {_TOTALS} FROM (SELECT {METRICS_SQL} FROM facts WHERE {_RANGE})")
def statistics_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.totals(in_range(spark, sf_dir)))


_MODEL_TABLE = f"""m AS (SELECT model, {METRICS_SQL} FROM facts WHERE {_RANGE} GROUP BY model)"""


@query(BASE_CTE + f", {_MODEL_TABLE} SELECT model, requests, total_tokens, input_tokens, output_tokens, cache_create_tokens, cache_read_tokens, round(cost + 1e-9, 4) AS cost, round(100.0 * total_tokens / sum(total_tokens) OVER (), 4) AS percent, success_requests, client_errors + server_errors AS error_requests, round(rate_sum / nullif(rate_count, 0), 4) AS avg_rate, round(ttft_sum / nullif(ttft_count, 0), 4) AS avg_ttft_ms FROM m")
def statistics_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.model_table(in_range(spark, sf_dir)))


@query(BASE_CTE + f"SELECT model, status_code, CAST(sum(request_count) AS BIGINT) AS requests FROM facts WHERE {_RANGE} AND status_code IS NOT NULL GROUP BY ALL")
def model_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_histogram(in_range(spark, sf_dir), "model")


_TREND = "coalesce(requests, 0) AS requests, coalesce(total_tokens, 0) AS total_tokens, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens, coalesce(cache_create_tokens, 0) AS cache_create_tokens, coalesce(cache_read_tokens, 0) AS cache_read_tokens, round(coalesce(cost, 0) + 1e-9, 4) AS cost"


@query(BASE_CTE + f", m AS (SELECT timestamp_sec // 3600 * 3600 AS bucket_start, {METRICS_SQL} FROM facts WHERE {_RANGE} GROUP BY 1) SELECT s.bucket_start, strftime(make_timestamp(s.bucket_start * 1000000), '%m-%d %H:00') AS label, {_TREND} FROM (SELECT unnest(generate_series(CAST({START} AS BIGINT), {END - 1}, 3600)) AS bucket_start) s LEFT JOIN m USING (bucket_start)")
def hourly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.trend(in_range(spark, sf_dir), START, END, cal.HOUR))


@query(BASE_CTE + f", m AS (SELECT timestamp_sec // 86400 * 86400 AS bucket_start, {METRICS_SQL} FROM facts WHERE {_RANGE} GROUP BY 1) SELECT s.bucket_start, strftime(make_timestamp(s.bucket_start * 1000000), '%m-%d') AS label, {_TREND} FROM (SELECT unnest(generate_series(CAST({START} AS BIGINT), {END - 1}, 86400)) AS bucket_start) s LEFT JOIN m USING (bucket_start)")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.trend(in_range(spark, sf_dir), START, END, cal.DAY))


@query(BASE_CTE + f", {_MODEL_TABLE}, top AS (SELECT model FROM m ORDER BY total_tokens DESC, model LIMIT 3), t AS (SELECT timestamp_sec // 86400 * 86400 AS bucket_start, model, {METRICS_SQL} FROM facts JOIN top USING (model) WHERE {_RANGE} GROUP BY ALL) SELECT s.bucket_start, strftime(make_timestamp(s.bucket_start * 1000000), '%m-%d') AS label, top.model, {_TREND} FROM (SELECT unnest(generate_series(CAST({START} AS BIGINT), {END - 1}, 86400)) AS bucket_start) s CROSS JOIN top LEFT JOIN t ON t.bucket_start = s.bucket_start AND t.model = top.model")
def top_model_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.model_trends(in_range(spark, sf_dir), START, END, cal.DAY, n=3))


_PERF = f"""{_MODEL_TABLE}, a AS (SELECT *, rate_sum / nullif(rate_count, 0) AS avg_rate, ttft_sum / nullif(ttft_count, 0) AS avg_ttft FROM m)"""
_PERF_ROW = "SELECT coalesce(sum(rate_sum) / nullif(sum(rate_count), 0), 0) AS avg_rate, coalesce(sum(ttft_sum) / nullif(sum(ttft_count), 0), 0) AS avg_ttft_ms, arg_max(model, avg_rate) AS fastest_model, arg_max(model, avg_ttft) AS slowest_model, CAST(greatest(sum(rate_count), sum(ttft_count)) AS BIGINT) AS samples FROM a"


@query(BASE_CTE + f", {_PERF} SELECT * REPLACE (round(avg_rate, 4) AS avg_rate, round(avg_ttft_ms, 4) AS avg_ttft_ms) FROM ({_PERF_ROW})")
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.performance(in_range(spark, sf_dir)))


@query(BASE_CTE + f"SELECT success_requests, client_errors, server_errors, client_errors + server_errors AS error_requests, round(100.0 * success_requests / (success_requests + client_errors + server_errors), 4) AS success_rate FROM (SELECT {METRICS_SQL} FROM facts WHERE {_RANGE})")
def status_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.status_block(in_range(spark, sf_dir)))


@query(BASE_CTE + "SELECT bool_or(status_code IS NOT NULL) AS has_status, bool_or(coalesce(duration_ms > 0 AND output_tokens_per_second > 0 OR ttft_ms > 0, false)) AS has_performance FROM facts")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.capabilities(facts(spark, sf_dir))


@query(
    BASE_CTE
    + f""", {_PERF}, p AS ({_PERF_ROW}), h AS (SELECT timestamp_sec // 86400 * 86400 AS b, CAST(sum(total_tokens) AS BIGINT) AS t FROM facts WHERE {_RANGE} GROUP BY 1)
SELECT 1 AS place, 'peak' AS kind, 'info' AS level, CAST(t AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS model, strftime(make_timestamp(b * 1000000), '%m-%d') AS date FROM (SELECT * FROM h ORDER BY t DESC, b DESC LIMIT 1)
UNION ALL SELECT 2, 'topModel', 'info', printf('%.1f', 100.0 * total_tokens / (SELECT sum(total_tokens) FROM m)), model, NULL FROM (SELECT * FROM m ORDER BY total_tokens DESC, model LIMIT 1)
UNION ALL SELECT 3, 'errors', 'warning', CAST(CAST(sum(client_errors + server_errors) AS BIGINT) AS VARCHAR), NULL, NULL FROM m HAVING sum(client_errors + server_errors) > 0
UNION ALL SELECT 4, 'slowestModel', 'info', printf('%.0f', avg_ttft_ms), slowest_model, NULL FROM p"""
)
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.insights(in_range(spark, sf_dir), cal.DAY)


def _daily(by: str = "") -> str:
    kinds = {"": "true", "visible_": "(status_code IS NULL OR status_code < 300)", "success_": "status_code < 400"}
    cols = [f"CAST(coalesce(sum(request_count) FILTER ({c}), 0) AS BIGINT) AS {k}requests" for k, c in kinds.items()]
    cols += [f"CAST(coalesce(sum({t}) FILTER ({c}), 0) AS BIGINT) AS {k}{t}" for k, c in kinds.items() for t in ("total_tokens", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")]
    cols += [f"round(coalesce(sum(estimated_cost) FILTER ({c}), 0) + 1e-9, 4) AS {k}cost" for k, c in kinds.items()]
    parts = {"client_errors": "status_code BETWEEN 400 AND 499", "server_errors": "status_code >= 500", "proxy_backed": "coverage_origin <> 'local_only'", "local_only": "coverage_origin = 'local_only'", "overlap": "coverage_origin = 'merged_proxy_preferred'"}
    cols += [f"CAST(coalesce(sum(request_count) FILTER ({c}), 0) AS BIGINT) AS {k}" for k, c in parts.items()]
    if not by:
        cols += ["count(DISTINCT model) AS models", "count(DISTINCT model) FILTER (status_code < 400) AS success_models"]
    return f"SELECT *, proxy_backed > 0 AND local_only > 0 AS is_partial FROM (SELECT strftime(make_timestamp(timestamp_sec * 1000000), '%Y-%m-%d') AS local_date{by}, {', '.join(cols)} FROM facts GROUP BY ALL)"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).withColumn("local_date", cal.business_date(F.col("timestamp_sec")).cast("string"))


@query(BASE_CTE + _daily())
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.daily_summary(dated(spark, sf_dir)))


@query(BASE_CTE + _daily(", model"))
def daily_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.daily_summary(dated(spark, sf_dir), "model"))


WINDOWS = {w: cal.window_start(w, AS_OF) for w in ("5h", "24h", "7d", "30d", "today", "current_month")}
_WINDOWS = ", ".join(f"('{w}', {s})" for w, s in WINDOWS.items())


@query(BASE_CTE + f", w(win, since) AS (VALUES {_WINDOWS}) SELECT win AS \"window\", {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('requests', 'total_tokens', 'input_tokens', 'output_tokens', 'cache_create_tokens', 'cache_read_tokens', 'success_requests', 'client_errors', 'server_errors'))}, round(coalesce(cost, 0) + 1e-9, 4) AS cost, round(rate_sum / nullif(rate_count, 0), 4) AS avg_rate FROM w LEFT JOIN (SELECT win, {METRICS_SQL} FROM w JOIN facts ON timestamp_sec >= since AND timestamp_sec <= {AS_OF} GROUP BY win) USING (win)")
def window_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.window_usage(facts(spark, sf_dir).where(F.col("timestamp_sec") <= AS_OF), WINDOWS))


@query(BASE_CTE + f", m AS (SELECT model, {METRICS_SQL} FROM facts WHERE model <> 'unknown' AND timestamp_sec >= {WINDOWS['7d']} GROUP BY model) SELECT model, total_tokens, requests, round(100.0 * total_tokens / sum(total_tokens) OVER (), 4) AS percent FROM m ORDER BY total_tokens DESC, model LIMIT 5")
def model_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.distribution(facts(spark, sf_dir).where(F.col("timestamp_sec") >= WINDOWS["7d"])))


def _ranking(by: str, table: str = "facts") -> str:
    return f", m AS (SELECT {by}, {METRICS_SQL} FROM {table} GROUP BY ALL) SELECT {by}, requests, total_tokens, round(cost + 1e-9, 4) AS cost, round(CASE WHEN sum(cost) OVER () > 0 THEN 100 * cost / sum(cost) OVER () ELSE 100.0 * total_tokens / sum(total_tokens) OVER () END, 4) AS percent, CASE WHEN status_facts > 0 THEN success_requests END AS success_requests, CASE WHEN status_facts > 0 THEN client_errors + server_errors END AS error_requests, round(rate_sum / nullif(rate_count, 0), 4) AS avg_rate, round(ttft_sum / nullif(ttft_count, 0), 4) AS avg_ttft_ms, last_seen_ms FROM m"


@query(BASE_CTE + _ranking("model"))
def ranking_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.ranking(facts(spark, sf_dir), "model"))


@query(BASE_CTE + _ranking("tool"))
def ranking_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.ranking(facts(spark, sf_dir), "tool"))


_SOURCED = """, sf AS (SELECT *, CASE WHEN request_base_url IS NULL AND api_key_prefix IN ('sk-0', 'sk-1') THEN 'src-a' WHEN request_base_url = 'https://api1.example.com/v1' AND api_key_prefix IN ('sk-1', 'sk-2') THEN 'src-b'
  WHEN request_base_url IS NULL AND api_key_prefix IS NULL THEN 'local' WHEN request_base_url IS NULL THEN '__official_api__' ELSE regexp_extract(request_base_url, '://([^/]*)', 1) END AS source_key FROM facts),
sn AS (SELECT *, CASE source_key WHEN 'src-a' THEN 'Alpha' ELSE source_key END AS source_name FROM sf)"""


@query(BASE_CTE + _SOURCED + _ranking("source_key, source_name", "sn"))
def ranking_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.ranking(statistics.with_source(facts(spark, sf_dir), sources(spark)), "source_key", "source_name"))


@query(BASE_CTE + f", m AS (SELECT model, {METRICS_SQL} FROM facts WHERE {_RANGE} GROUP BY model) SELECT model, rate_count AS requests, rate_tokens, rate_ms, round(rate_sum / rate_count, 4) AS avg_rate, round(min_rate, 4) AS min_rate, round(max_rate, 4) AS max_rate FROM m WHERE rate_count > 0")
def rates_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.rates_by_model(in_range(spark, sf_dir)))


@query(BASE_CTE + f", m AS (SELECT model, {METRICS_SQL} FROM facts WHERE {_RANGE} GROUP BY model) SELECT model, ttft_count AS requests, round(ttft_sum / ttft_count, 4) AS avg_ttft_ms, min_ttft_ms, max_ttft_ms FROM m WHERE ttft_count > 0")
def first_tokens_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.first_tokens_by_model(in_range(spark, sf_dir)))


@query(BASE_CTE + f"SELECT rate_count AS requests, rate_tokens, rate_ms, round(rate_sum / rate_count, 4) AS avg_rate, ttft_count AS ttft_requests, round(ttft_sum / ttft_count, 4) AS avg_ttft_ms FROM (SELECT {METRICS_SQL} FROM facts WHERE {_RANGE})")
def overall_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.overall_rate(in_range(spark, sf_dir)))


@query(BASE_CTE + "SELECT count(*) AS total, count(*) FILTER (coverage_origin <> 'local_only') AS proxy_backed, count(*) FILTER (coverage_origin = 'local_only') AS local_only, count(*) FILTER (coverage_origin = 'merged_proxy_preferred') AS overlap, true AS is_partial FROM facts")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coverage(facts(spark, sf_dir))


@query(BASE_CTE + "SELECT * FROM (SELECT canonical_request_key, timestamp_ms, model, tool, total_tokens, round(estimated_cost + 1e-9, 6) AS estimated_cost, status_code FROM facts ORDER BY timestamp_ms DESC, canonical_request_key LIMIT 30 OFFSET 60)")
def recent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).recent_requests(Context(AS_OF), 30, 60).select("canonical_request_key", "timestamp_ms", "model", "tool", "total_tokens", F.round(F.col("estimated_cost") + 1e-9, 6).alias("estimated_cost"), "status_code")
