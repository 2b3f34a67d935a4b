"""Queries: sessions, projects, survival, calendar, matching and prices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import calendar as cal
from meterlake.operators import activity, maintenance, pricing, reconcile, survival
from meterlake.operators import sessions as S
from meterlake.operators.metrics import coverage as coverage_of
from meterlake.plans.commands import Context
from meterlake.queries.bindings import AS_OF, BASE_CTE, END, START, facts, local, prices, proxy, read, remote, sessions, sources, usage, _columns
from meterlake.queries.registry import query, rounded

_T = ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")
_ROLL = """, roll AS (
  SELECT session_id, min(tool) AS tool, max(project_name) AS project_name, max(project_path) AS project_path, count(*) AS requests, CAST(sum(request_count) AS BIGINT) AS weighted_requests,
    CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_create_tokens) AS BIGINT) AS cache_create_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
    CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(estimated_cost) AS cost, min(timestamp_sec) AS first_request, max(timestamp_sec) AS last_request, string_agg(DISTINCT model, ',' ORDER BY model) AS models,
    coalesce(avg(output_tokens_per_second) FILTER (output_tokens_per_second > 0), 0) AS avg_rate, coalesce(avg(ttft_ms) FILTER (ttft_ms > 0), 0) AS avg_ttft_ms,
    count(*) FILTER (coverage_origin <> 'local_only') AS proxy_backed, count(*) FILTER (coverage_origin = 'local_only') AS local_only,
    count(*) FILTER (status_code < 400 AND coverage_origin <> 'local_only') AS ok, count(*) FILTER (status_code >= 400 AND coverage_origin <> 'local_only') AS bad
  FROM facts WHERE trim(session_id) <> '' GROUP BY session_id
), every AS (
  SELECT * EXCLUDE (ok, bad), proxy_backed > 0 AND local_only > 0 AS is_partial, CASE WHEN proxy_backed > 0 AND local_only > 0 THEN 0 ELSE ok END AS success_requests, CASE WHEN proxy_backed > 0 AND local_only > 0 THEN 0 ELSE bad END AS error_requests, true AS has_facts FROM roll
  UNION ALL BY NAME
  SELECT session_id, tool, project_name, cwd AS project_path, CAST(request_count AS BIGINT) AS requests, CAST(request_count AS BIGINT) AS weighted_requests, input_tokens, output_tokens, cache_create_tokens, cache_read_tokens,
    input_tokens + output_tokens + cache_create_tokens + cache_read_tokens AS total_tokens, 0.0 AS cost, start_time AS first_request, last_modified AS last_request, array_to_string(list_sort(models), ',') AS models, 0.0 AS avg_rate, 0.0 AS avg_ttft_ms,
    0 AS proxy_backed, 0 AS local_only, false AS is_partial, 0 AS success_requests, 0 AS error_requests, false AS has_facts
  FROM sessions WHERE session_id NOT IN (SELECT session_id FROM roll)
)"""
_SHOWN = "* REPLACE (round(cost + 1e-9, 4) AS cost, round(avg_rate, 4) AS avg_rate, round(avg_ttft_ms, 4) AS avg_ttft_ms)"


def _flat(rows: DataFrame) -> DataFrame:
    return rounded(rows.withColumn("models", F.array_join("models", ",")))


@query(BASE_CTE + _ROLL + f"SELECT {_SHOWN} FROM every")
def sessions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(S.all_sessions(facts(spark, sf_dir), sessions(spark, sf_dir)))


@query(BASE_CTE + _ROLL + f"SELECT {_SHOWN} FROM every ORDER BY last_request DESC, session_id LIMIT 20 OFFSET 5")
def sessions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(S.latest(S.all_sessions(facts(spark, sf_dir), sessions(spark, sf_dir)), 20, 5))


@query(BASE_CTE + _ROLL + f"SELECT {_SHOWN} FROM every WHERE session_id = 's42'")
def session_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of one session are found first; nothing else is merged or rolled up."""
    return _flat(usage(spark, sf_dir).session_detail(Context(AS_OF), "s42"))


_PROJECTS = """, pf AS (
  SELECT CASE WHEN trim(coalesce(project_path, '')) <> '' THEN project_path WHEN trim(coalesce(project_name, '')) <> '' THEN 'name::' || project_name WHEN trim(session_id) <> '' THEN 'unknown::' || session_id ELSE 'unknown::fact::' || canonical_request_key END AS project_key,
    coalesce(string_split(project_path, '/')[-1], project_name) AS name, tool, session_id, request_count AS requests, total_tokens, estimated_cost AS cost, timestamp_sec AS seen, CASE WHEN coverage_origin = 'local_only' THEN 0 ELSE request_count END AS covered FROM facts
  UNION ALL
  SELECT CASE WHEN cwd IS NOT NULL THEN cwd WHEN project_name IS NOT NULL THEN 'name::' || project_name ELSE 'unknown::' || session_id END, coalesce(string_split(cwd, '/')[-1], project_name), tool, session_id, request_count,
    input_tokens + output_tokens + cache_create_tokens + cache_read_tokens, 0, last_modified, 0 FROM sessions WHERE session_id NOT IN (SELECT session_id FROM facts)
)"""
_PROJECT_SUMS = "count(DISTINCT session_id) FILTER (trim(session_id) <> '') AS sessions, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost) + 1e-9, 4) AS cost, CAST(sum(covered) AS BIGINT) AS covered, max(seen) AS last_active"


@query(BASE_CTE + _PROJECTS + f"SELECT project_key, max(name) AS name, {_PROJECT_SUMS} FROM pf GROUP BY project_key")
def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.project_rollup(facts(spark, sf_dir), sessions(spark, sf_dir))[0])


@query(BASE_CTE + _PROJECTS + f"SELECT project_key, tool, {_PROJECT_SUMS} FROM pf GROUP BY ALL")
def project_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.project_rollup(facts(spark, sf_dir), sessions(spark, sf_dir))[1])


@query(
    BASE_CTE
    + """SELECT session_id, CASE WHEN count(DISTINCT client_tool) > 1 THEN 'mixed' ELSE min(client_tool) END AS tool, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
CAST(sum(cache_create_tokens) AS BIGINT) AS cache_create_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, round(sum(estimated_cost) + 1e-9, 4) AS cost, string_agg(DISTINCT model, ',' ORDER BY model) AS models,
round(coalesce(avg(ttft_ms) FILTER (ttft_ms > 0), 0), 4) AS avg_ttft_ms, round(coalesce(sum(output_tokens) * 1000.0 / nullif(sum(duration_ms), 0), 0), 4) AS avg_rate, min(timestamp) AS first_ms, max(timestamp) AS last_ms FROM proxy WHERE trim(session_id) <> '' GROUP BY session_id"""
)
def proxy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.proxy_sessions(proxy(spark, sf_dir)))


_ASKED = "asked AS (SELECT message_id, timestamp // 1000 AS secs, lower(regexp_replace(model, '[^A-Za-z0-9]', '', 'g')) AS m FROM proxy WHERE session_id = '')"
_CANDIDATES = f"""{_ASKED}, cand AS (
  SELECT DISTINCT message_id, s.session_id FROM asked JOIN sessions s ON secs >= start_time - 15 AND secs <= last_modified + 15 AND (m = 'view' OR m = lower(s.models[2]))
)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy(spark, sf_dir).where("session_id = ''").withColumn("at", F.expr("timestamp div 1000"))


@query(BASE_CTE + f", {_CANDIDATES} SELECT a.message_id, CASE WHEN n = 1 THEN s END AS session_id, CASE WHEN n = 1 THEN 'known' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS state FROM asked a LEFT JOIN (SELECT message_id, count(*) AS n, min(session_id) AS s FROM cand GROUP BY 1) USING (message_id)")
def resolved_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resolved_sessions(_asked(spark, sf_dir), sessions(spark, sf_dir), "message_id", "at")


@query(BASE_CTE + f", {_CANDIDATES} SELECT session_id, count(*) AS unresolved FROM cand GROUP BY 1")
def unresolved_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unresolved_per_session(_asked(spark, sf_dir), sessions(spark, sf_dir), "message_id", "at")


@query(
    BASE_CTE
    + _ROLL
    + f""", {_CANDIDATES} SELECT s.session_id, coalesce(n, 0) AS unresolved, CASE WHEN roll.session_id IS NULL THEN 'none' WHEN roll.requests = s.request_count AND first_request <= start_time + 30 AND last_request >= end_time - 30 AND coalesce(n, 0) = 0 THEN 'covered' ELSE 'partial' END AS state
FROM sessions s LEFT JOIN roll USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM cand GROUP BY 1) c ON c.session_id = s.session_id"""
)
def session_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = sessions(spark, sf_dir)
    return S.session_coverage(known, S.session_rollup(facts(spark, sf_dir)), S.unresolved_per_session(_asked(spark, sf_dir), known, "message_id", "at"))


@query(BASE_CTE + "SELECT CAST(sum(request_count) AS BIGINT) AS total, CAST(sum(request_count) FILTER (coverage_origin <> 'local_only') AS BIGINT) AS proxy_backed, CAST(sum(request_count) FILTER (coverage_origin = 'local_only') AS BIGINT) AS local_only, CAST(sum(request_count) FILTER (coverage_origin = 'merged_proxy_preferred') AS BIGINT) AS overlap, true AS is_partial FROM facts")
def coverage_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_of(facts(spark, sf_dir), weighted=True)


_BURN = f"SELECT count(*) AS n, coalesce(sum(total_tokens), 0) AS t, greatest({AS_OF} - min(timestamp_sec), 1) AS span FROM facts WHERE timestamp_sec BETWEEN {AS_OF} - 5400 AND {AS_OF}"


@query(BASE_CTE + f"SELECT round(t / (span / 3600.0), 4) AS tokens_per_hour, round(n / (span / 3600.0), 4) AS requests_per_hour, span AS sample_seconds, n AS sample_requests, CASE WHEN n >= 8 AND span >= 1800 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM ({_BURN})")
def burn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survival.burn_rate(facts(spark, sf_dir), AS_OF))


_BASE = f"SELECT count(*) AS active_hours, avg(t) AS avg_tokens_per_hour FROM (SELECT timestamp_sec // 3600 AS h, sum(total_tokens) AS t FROM facts WHERE timestamp_sec BETWEEN {AS_OF} - 604800 AND {AS_OF} GROUP BY 1 HAVING sum(total_tokens) > 0)"


@query(BASE_CTE + f"SELECT active_hours, round(avg_tokens_per_hour, 4) AS avg_tokens_per_hour FROM ({_BASE})")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survival.baseline(facts(spark, sf_dir), AS_OF))


# a block's next opening is the first time five hours or more behind it, or behind a gap
_BLOCKS = f""", tm AS (SELECT DISTINCT user_k, timestamp_sec AS t FROM (SELECT *, session_id AS user_k FROM facts WHERE session_id <> '' AND timestamp_sec BETWEEN {AS_OF} - 604800 AND {AS_OF})),
gp AS (SELECT user_k, t, lag(t) OVER (PARTITION BY user_k ORDER BY t) AS prev FROM tm),
blocks AS (
  SELECT user_k, min(t) AS start FROM tm GROUP BY user_k
  UNION
  SELECT b.user_k, (SELECT min(g.t) FROM gp g WHERE g.user_k = b.user_k AND g.t > b.start AND (g.t - b.start >= 18000 OR g.t - g.prev >= 18000)) AS start FROM blocks b WHERE b.start IS NOT NULL
)"""
_BLOCK_SQL = BASE_CTE.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + _BLOCKS


@query(
    _BLOCK_SQL
    + f"""SELECT b.user_k AS session_id, start AS start_epoch, start + 18000 AS resets_at_epoch, CAST(sum(f.total_tokens) AS BIGINT) AS used_tokens, count(*) AS used_requests, {AS_OF} - start AS elapsed_seconds, start + 18000 - {AS_OF} AS remaining_seconds
FROM (SELECT user_k, max(start) AS start FROM blocks GROUP BY 1) b JOIN facts f ON f.session_id = b.user_k AND f.timestamp_sec BETWEEN b.start AND {AS_OF} WHERE start + 18000 > {AS_OF} GROUP BY ALL"""
)
def anchored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.current_blocks(facts(spark, sf_dir).where("session_id <> ''"), AS_OF, "session_id")


@query(
    BASE_CTE.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1)
    + _BLOCKS.replace("session_id AS user_k", "1 AS user_k").replace("WHERE session_id <> '' AND", "WHERE")
    + f""", br AS (SELECT t / (span / 3600.0) AS tph, n / (span / 3600.0) AS rph, span, n FROM ({_BURN})), bs AS ({_BASE}),
cb AS (SELECT start, CAST(sum(f.total_tokens) AS BIGINT) AS used, count(*) AS reqs FROM (SELECT max(start) AS start FROM blocks) b JOIN facts f ON f.timestamp_sec BETWEEN b.start AND {AS_OF} GROUP BY 1)
SELECT 'baseline' AS source_kind, round(tph, 4) AS tokens_per_hour, round(rph, 4) AS requests_per_hour, span AS sample_seconds, n AS sample_requests, CASE WHEN n >= 8 AND span >= 1800 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS confidence,
round(avg_tokens_per_hour, 4) AS avg_tokens_per_hour, round(tph / avg_tokens_per_hour, 4) AS relative_to_baseline, start AS start_epoch, start + 18000 AS resets_at_epoch, used AS used_tokens, reqs AS used_requests, {AS_OF} - start AS elapsed_seconds, start + 18000 - {AS_OF} AS remaining_seconds,
CAST(used + floor(tph * ((start + 18000 - {AS_OF}) / 3600.0)) AS BIGINT) AS projected_end_tokens FROM br, bs, cb"""
)
def survival_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survival.survival(facts(spark, sf_dir), AS_OF))


_DAYS = ", days AS (SELECT CAST(make_timestamp((timestamp_sec - {shift}) * 1000000) AS DATE) AS day, CAST(sum(request_count) AS BIGINT) AS requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(estimated_cost) AS cost, count(DISTINCT model) AS models FROM facts GROUP BY 1)"
_CALENDAR = ", cal AS (SELECT d.day, coalesce(requests, 0) AS requests, coalesce(total_tokens, 0) AS total_tokens, coalesce(cost, 0) AS cost, coalesce(models, 0) AS models FROM (SELECT CAST(unnest(generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN days ON days.day = d.day) SELECT CAST(day AS VARCHAR) AS day, requests, total_tokens, round(cost + 1e-9, 4) AS cost, models, CASE WHEN {v} <= 0 THEN 0 WHEN {v} / max({v}) OVER () < 0.25 THEN 1 WHEN {v} / max({v}) OVER () < 0.5 THEN 2 WHEN {v} / max({v}) OVER () < 0.75 THEN 3 ELSE 4 END AS level FROM cal"


@query(BASE_CTE + _DAYS.format(shift=0) + _CALENDAR.format(a="2024-01-01", b="2024-01-31", v="total_tokens"))
def month_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(activity.month_activity(activity.day_activity(facts(spark, sf_dir)), 2024, 1))


@query(BASE_CTE + _DAYS.format(shift=4 * 3600) + _CALENDAR.format(a="2024-01-01", b="2024-12-31", v="requests"))
def year_activity_night_owl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that begin at four in the morning."""
    return rounded(activity.year_activity(activity.day_activity(facts(spark, sf_dir), boundary=4), 2024, "requests"))


@query(BASE_CTE + _DAYS.format(shift=0) + "SELECT CAST(day AS VARCHAR) AS day, requests, total_tokens, round(cost + 1e-9, 4) AS cost, models FROM days")
def activity_with_hot_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored days and the live one give what a full computation gives."""
    today, f = date(2024, 1, 30), facts(spark, sf_dir)
    since, _ = cal.business_day_bounds(today)
    old, new = (activity.day_activity(f.where(c)) for c in (F.col("timestamp_sec") < since, F.col("timestamp_sec") >= since))
    return rounded(activity.with_hot_day(old, new, today).withColumn("day", F.col("day").cast("string")))


@query("""
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders),
s AS (SELECT CAST(unnest(generate_series(m, last_day(m), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT date_trunc('month', day) AS m FROM o))
SELECT CAST(s.day AS VARCHAR) AS day, CAST((dayofmonth(s.day) - 1 + isodow(date_trunc('month', s.day)) - 1) // 7 AS INTEGER) AS week_row, CAST(isodow(s.day) - 1 AS INTEGER) AS weekday, CAST(isodow(date_trunc('month', s.day)) - 1 AS INTEGER) AS blanks_before, CAST(7 - isodow(last_day(s.day)) AS INTEGER) AS blanks_after, count(o.day) AS orders
FROM s LEFT JOIN o USING (day) GROUP BY s.day
""")
def calendar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months that have orders, whole, on a grid with the orders of each day."""
    own = read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("orders"))
    month = F.trunc("day", "month")
    spine = own.select(month.alias("m")).distinct().select(F.explode(F.sequence("m", F.last_day("m"))).alias("day"))
    return activity.calendar_grid(spine.join(own, "day", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))).withColumn("day", F.col("day").cast("string"))


@query(BASE_CTE + "SELECT DISTINCT strftime(make_timestamp(timestamp_sec * 1000000), '%Y-%m-%d') AS day FROM facts WHERE session_id = 's7'")
def history_days_of_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.history_days(facts(spark, sf_dir), F.col("session_id") == "s7").withColumn("day", F.col("day").cast("string"))


@query(BASE_CTE + "SELECT model, p.id AS price_id, p.i AS input_price, p.o AS output_price, round(p.r, 6) AS cache_read_price, p.w AS cache_write_price FROM best")
def fuzzy_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = local(spark, sf_dir).select("model").unionByName(remote(spark, sf_dir).select("model"))
    return pricing.priced_models(seen, prices(spark)).withColumns({"cache_read_price": F.round(F.coalesce("cache_read_price", F.col("input_price") * 0.1), 6), "cache_write_price": F.coalesce("cache_write_price", F.lit(0.0))})


@query(
    BASE_CTE
    + """SELECT model, round(sum(input_tokens * coalesce(p.input_price, 0) + output_tokens * coalesce(p.output_price, 0) + cache_create_tokens * coalesce(p.cache_write_price, 0) + cache_read_tokens * coalesce(p.cache_read_price, p.input_price * 0.1, 0)) / 1e6 + 1e-9, 4) AS cost, count(*) AS n
FROM local LEFT JOIN (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY source DESC) = 1) p ON p.model_id = model GROUP BY model"""
)
def exact_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pricing.with_cost(local(spark, sf_dir), prices(spark), exact=True).groupBy("model").agg(F.sum("cost").alias("cost"), F.count("*").alias("n")))


_REPRICED = f"NOT cost_locked AND model IN ('view', 'click') AND timestamp // 1000 BETWEEN {START} AND {END} AND client_tool IN ('codex', 'qoder_ide')"


def _repriced():
    from meterlake.operators.filters import repriced

    return repriced(F.col("model"), F.expr("timestamp div 1000"), F.col("client_tool"), F.col("api_key_prefix"), F.col("cost_locked"), ["view", "click"], START, END, ["codex", "qoder_ide"])


@query(BASE_CTE + f"SELECT model, count(*) AS n_records, round(sum(estimated_cost) + 1e-9, 4) AS current_cost FROM proxy WHERE {_REPRICED} GROUP BY model")
def repricing_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pricing.preview_repricing(proxy(spark, sf_dir), _repriced()))


@query(BASE_CTE + f"SELECT model, cost_locked, count(*) AS n, round(sum(cost) + 1e-9, 4) AS cost FROM (SELECT model, cost_locked OR {_REPRICED} AS cost_locked, CASE WHEN {_REPRICED} THEN (input_tokens * 2.0 + output_tokens * 6.0 + cache_read_tokens * 0.2) / 1e6 ELSE estimated_cost END AS cost FROM proxy) GROUP BY ALL")
def repricing_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pricing.repriced_records(proxy(spark, sf_dir), _repriced(), {"input_price": 2.0, "output_price": 6.0})
    return rounded(done.groupBy("model", "cost_locked").agg(F.count("*").alias("n"), F.sum("estimated_cost").alias("cost")))


@query(
    BASE_CTE
    + """, pb AS (SELECT DISTINCT ON (model, model_id) model, p.* FROM (SELECT DISTINCT model, lower(model) AS lm FROM proxy) m, prices p WHERE model = model_id OR lm = lower(model_id) OR contains(lm, lower(model_id)) OR contains(lower(model_id), lm) OR contains(regexp_replace(lm, '[^a-z0-9]', '', 'g'), regexp_replace(lower(model_id), '[^a-z0-9]', '', 'g')) OR contains(regexp_replace(lower(model_id), '[^a-z0-9]', '', 'g'), regexp_replace(lm, '[^a-z0-9]', '', 'g')) ORDER BY model, model_id, source DESC),
bp AS (SELECT * FROM pb QUALIFY row_number() OVER (PARTITION BY model ORDER BY CASE WHEN model = model_id THEN 0 WHEN lower(model) = lower(model_id) THEN 1 WHEN contains(lower(model), lower(model_id)) OR contains(lower(model_id), lower(model)) THEN 2 ELSE 3 END, source DESC, rank) = 1)
SELECT proxy.model, round(sum(CASE WHEN cost_locked THEN estimated_cost ELSE (input_tokens * coalesce(input_price, 0) + output_tokens * coalesce(output_price, 0) + cache_create_tokens * coalesce(cache_write_price, 0) + cache_read_tokens * coalesce(cache_read_price, input_price * 0.1, 0)) / 1e6 END) + 1e-9, 4) AS cost, count(*) AS n FROM proxy LEFT JOIN bp ON bp.model = proxy.model GROUP BY proxy.model"""
)
def frozen_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pricing.frozen_costs(proxy(spark, sf_dir), prices(spark)).groupBy("model").agg(F.sum("estimated_cost").alias("cost"), F.count("*").alias("n")))


@query("SELECT p_brand AS model_id, round(arg_max(p_retailprice, p_partkey), 2) AS input_price FROM part GROUP BY 1")
def newest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = read(spark, sf_dir, "part").select(F.col("p_brand").alias("model_id"), F.lit("x").alias("provider"), F.col("p_retailprice").alias("input_price"), F.lit(None).cast("double").alias("output_price"), F.col("p_partkey").alias("last_updated"))
    return pricing.newest_prices(offers).select("model_id", F.round("input_price", 2).alias("input_price"))


@query("SELECT * FROM (SELECT DISTINCT p_name AS model_id FROM part WHERE contains(lower(p_name), 'wid') OR contains(lower(p_name), 'blue')) ORDER BY 1 LIMIT 8 OFFSET 2")
def price_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterlake.operators.filters import price_matches

    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("model_id")).distinct()
    return pricing.search(names, price_matches(F.col("model_id"), F.lit(None).cast("string"), " WID ") | price_matches(F.col("model_id"), F.col("model_id"), "blue"), 8, 2)


#: Parts as stored prices, some of them custom, and as what a sync brings.
_STORED = "SELECT concat('m', p_partkey) AS model_id, p_name AS display_name, CASE WHEN p_partkey % 3 = 0 THEN 'custom' ELSE 'api' END AS source, 1 AS last_updated FROM part WHERE p_partkey % 2 = 0"
_SYNCED = "SELECT concat('m', p_partkey) AS model_id, 'Synced' AS display_name, 'api' AS source, 7 AS last_updated FROM part WHERE p_partkey % 5 <> 0"


@query(f"SELECT model_id, coalesce(CASE WHEN s.source = 'custom' THEN s.display_name END, n.display_name, s.display_name) AS display_name, CASE WHEN s.source = 'custom' THEN 'custom' ELSE 'api' END AS source, CASE WHEN s.source = 'custom' OR n.model_id IS NULL THEN 1 ELSE 7 END AS last_updated FROM ({_STORED}) s FULL JOIN ({_SYNCED}) n USING (model_id)")
def price_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sync replaces synced prices and adds new ones, and leaves custom ones alone."""
    parts = read(spark, sf_dir, "part")
    stored, synced = (parts.where(x.split(" WHERE ")[1]).selectExpr(*_columns(x.split("SELECT ")[1].split(" FROM part")[0])) for x in (_STORED, _SYNCED))
    return pricing.upserted(stored, synced)


@query(BASE_CTE + "SELECT strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS day, model, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_create_tokens) AS BIGINT) AS cache_create_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, round(sum(estimated_cost) + 1e-9, 4) AS cost, count(*) FILTER (status_code BETWEEN 200 AND 299) AS success_requests, count(*) FILTER (status_code >= 400) AS error_requests, count(DISTINCT session_id) AS sessions FROM proxy GROUP BY ALL")
def proxy_model_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maintenance.proxy_days(proxy(spark, sf_dir), ["model"]))


@query(BASE_CTE + "SELECT status_code, count(*) AS requests FROM proxy GROUP BY 1")
def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.status_counts(proxy(spark, sf_dir))


@query(BASE_CTE + f"SELECT count(*) AS requests, CAST(sum(output_tokens) AS BIGINT) AS rate_tokens, CAST(sum(duration_ms) AS BIGINT) AS rate_ms, round(sum(output_tokens) * 1000.0 / sum(duration_ms), 4) AS tokens_per_second FROM proxy WHERE duration_ms > 0 AND output_tokens > 0 AND timestamp >= {START * 1000}")
def window_ratio_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterlake.operators.statistics import ratio_rate

    return rounded(ratio_rate(proxy(spark, sf_dir).where(F.col("timestamp") >= START * 1000)))


@query()
def matched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matching depends on the order of records: held against a plain replay in the tests."""
    p = proxy(spark, sf_dir).withColumn("output_tokens", F.col("output_tokens") % 20).withColumn("input_tokens", F.lit(10)).withColumn("cache_create_tokens", F.lit(0)).withColumn("cache_read_tokens", F.lit(0)).withColumn("timestamp", F.col("timestamp") - F.col("timestamp") % 7000).withColumn("request_end_time", F.lit(0))
    mine = local(spark, sf_dir).withColumn("output_tokens", F.col("output_tokens") % 20).withColumn("input_tokens", F.lit(10)).withColumn("cache_create_tokens", F.lit(0)).withColumn("cache_read_tokens", F.lit(0)).withColumn("request_key", F.col("message_id")).drop("total_tokens")
    return reconcile.match_records(p, mine)


@query(BASE_CTE + "SELECT api_key_prefix, coalesce(request_base_url, '') AS base_url, min(timestamp) AS first_seen_ms, max(timestamp) AS last_seen_ms FROM proxy WHERE api_key_prefix IS NOT NULL AND NOT (request_base_url IS NULL AND api_key_prefix IN ('sk-0', 'sk-1')) AND NOT (coalesce(request_base_url, '') = 'https://api1.example.com/v1' AND api_key_prefix IN ('sk-1', 'sk-2')) GROUP BY ALL")
def new_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.new_sources(proxy(spark, sf_dir), sources(spark))


@query("""
WITH p AS (SELECT DISTINCT CASE c_nationkey WHEN 2 THEN 1 ELSE c_nationkey END AS n, concat('sk-', c_custkey % 50) AS prefix FROM customer)
SELECT concat('src-', n) AS id, string_agg(prefix, ',' ORDER BY prefix) AS prefixes FROM p GROUP BY n
""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each nation, of one url for five of them: the second joins the first, whose url it has; the seventh doesn't."""
    own = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("sk-"), (F.col("c_custkey") % 50).cast("string")))).alias("api_key_prefixes"))
    known = own.select(F.concat(F.lit("src-"), F.col("c_nationkey").cast("string")).alias("id"), "api_key_prefixes", F.concat(F.lit("https://r"), F.expr("c_nationkey div 5").cast("string")).alias("base_url"))
    done = maintenance.merged_sources(maintenance.merged_sources(known, "src-1", "src-2"), "src-1", "src-7")
    return done.select("id", F.array_join("api_key_prefixes", ",").alias("prefixes"))


@query(
    BASE_CTE
    + """SELECT session_id, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_create_tokens) AS BIGINT) AS cache_create_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, min(timestamp) AS first_ms, max(timestamp) AS last_ms, count(DISTINCT model) AS models,
round(coalesce(avg(ttft_ms) FILTER (ttft_ms > 0), 0), 4) AS avg_ttft_ms, round(coalesce(sum(output_tokens) * 1000.0 / nullif(sum(duration_ms), 0), 0), 4) AS rate FROM (SELECT p.* REPLACE (coalesce(l.session_id, '__legacy_unmatched__') AS session_id) FROM proxy p LEFT JOIN local l USING (message_id) WHERE p.session_id = '') GROUP BY session_id"""
)
def legacy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maintenance.legacy_sessions(proxy(spark, sf_dir), local(spark, sf_dir)))
