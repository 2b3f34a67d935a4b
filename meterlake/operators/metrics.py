"""The one aggregate that every report shares, and what is derived from it.

All states are sums, minima and maxima, so that Spark aggregates partially before a shuffle and stored partial results add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.numbers import percent
from meterlake.schemas import LOCAL_ONLY, MERGED


def _weight() -> Column:
    return F.greatest(F.col("request_count"), F.lit(1))


def _sum(value: Column, when: Column | None = None, otherwise=0) -> Column:
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(otherwise))


def fact_metrics() -> list[Column]:
    """Aggregates over FACTS. Requests count with their weight; rates and first-token times only where they are positive."""
    w, status = _weight(), F.col("status_code")
    rated = (F.col("duration_ms") > 0) & (F.col("output_tokens_per_second") > 0)
    rate, ttft = F.when(rated, F.col("output_tokens_per_second")), F.when(F.col("ttft_ms") > 0, F.col("ttft_ms"))
    return [
        _sum(w).alias("requests"),
        _sum(w, F.col("coverage_origin") == LOCAL_ONLY).alias("local_requests"),
        _sum(w, F.col("coverage_origin") != LOCAL_ONLY).alias("proxy_requests"),
        *(_sum(F.col(c)).alias(c) for c in ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")),
        _sum(F.col("input_tokens") + F.col("output_tokens") + F.col("cache_create_tokens") + F.col("cache_read_tokens")).alias("total_tokens"),
        _sum(F.col("estimated_cost"), otherwise=0.0).alias("cost"),
        F.count("status_code").alias("status_facts"),
        _sum(w, status.between(200, 299)).alias("success_requests"),
        _sum(w, status.between(400, 499)).alias("client_errors"),
        _sum(w, status >= 500).alias("server_errors"),
        _sum(rate, otherwise=0.0).alias("rate_sum"),
        F.count(rate).alias("rate_count"),
        _sum(F.col("output_tokens"), rated).alias("rate_tokens"),
        _sum(F.col("duration_ms"), rated).alias("rate_ms"),
        F.min(rate).alias("min_rate"),
        F.max(rate).alias("max_rate"),
        _sum(ttft).alias("ttft_sum"),
        F.count(ttft).alias("ttft_count"),
        F.min(ttft).alias("min_ttft_ms"),
        F.max(ttft).alias("max_ttft_ms"),
        F.max("timestamp_ms").alias("last_seen_ms"),
    ]


def measured(facts: DataFrame, *by: str | Column) -> DataFrame:
    return facts.groupBy(*by).agg(*fact_metrics())


_ADDED = ("requests", "local_requests", "proxy_requests", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens", "total_tokens", "cost", "status_facts", "success_requests", "client_errors", "server_errors", "rate_sum", "rate_count", "rate_tokens", "rate_ms", "ttft_sum", "ttft_count")


def remeasured(metrics: DataFrame, *by: str) -> DataFrame:
    """Metrics of metrics: the same as measuring the facts below them at once."""
    return metrics.groupBy(*by).agg(*added_up())


def added_up() -> list[Column]:
    """Aggregates over metrics."""
    return [
        *(_sum(F.col(c), otherwise=0.0 if c in ("cost", "rate_sum") else 0).alias(c) for c in _ADDED),
        *(F.min(c).alias(c) for c in ("min_rate", "min_ttft_ms")),
        *(F.max(c).alias(c) for c in ("max_rate", "max_ttft_ms", "last_seen_ms")),
    ]


def is_measured(rows: DataFrame) -> bool:
    """Whether rows are metrics already (of cells, say) and not facts."""
    return "rate_count" in rows.columns


def measures(rows: DataFrame, *by: str) -> DataFrame:
    """Metrics of facts, or of metrics that were stored before."""
    return remeasured(rows, *by) if is_measured(rows) else measured(rows, *by)


def averages() -> list[Column]:
    """Means over the samples, null without any."""
    return [F.try_divide(F.col("rate_sum"), F.col("rate_count")).alias("avg_rate"), F.try_divide(F.col("ttft_sum").cast("double"), F.col("ttft_count")).alias("avg_ttft_ms")]


def status_histogram(facts: DataFrame, *by: str) -> DataFrame:
    """(by, status_code, requests); rows without a status don't count."""
    n = F.col("requests") if is_measured(facts) else _weight()
    return facts.where("status_code IS NOT NULL").groupBy(*by, "status_code").agg(F.sum(n).alias("requests"))


def status_block(facts: DataFrame) -> DataFrame:
    """One row: successes, errors by class and the success rate in percent of those."""
    m = measures(facts)
    errors = F.col("client_errors") + F.col("server_errors")
    return m.select("success_requests", "client_errors", "server_errors", errors.alias("error_requests"), percent(F.col("success_requests"), F.col("success_requests") + errors).alias("success_rate"))


def capabilities(facts: DataFrame) -> DataFrame:
    """One row: is there any status, and any rate or first-token time?"""
    rated = (F.col("duration_ms") > 0) & (F.col("output_tokens_per_second") > 0)
    return facts.agg(F.coalesce(F.bool_or(F.col("status_code").isNotNull()), F.lit(False)).alias("has_status"), F.coalesce(F.bool_or(F.coalesce(rated | (F.col("ttft_ms") > 0), F.lit(False))), F.lit(False)).alias("has_performance"))


def coverage(facts: DataFrame, weighted: bool = False) -> DataFrame:
    """One row: facts (or, weighted, requests) with and without the proxy, and whether both kinds occur."""
    n = F.col("requests" if weighted else "facts") if is_measured(facts) else _weight() if weighted else F.lit(1)
    local, merged = F.col("coverage_origin") == LOCAL_ONLY, F.col("coverage_origin") == MERGED
    out = facts.agg(_sum(n).alias("total"), _sum(n, ~local).alias("proxy_backed"), _sum(n, local).alias("local_only"), _sum(n, merged).alias("overlap"))
    return out.withColumn("is_partial", (F.col("proxy_backed") > 0) & (F.col("local_only") > 0))


def stated_tokens() -> Column:
    """Totals as facts state them, which needn't be the sums of their parts: what a daily summary needs besides cells."""
    return F.sum("total_tokens").alias("stated_tokens")


def daily_summary(dated: DataFrame, *by: str) -> DataFrame:
    """Facts with a local_date, by day: all, visible and successful requests, tokens and cost, coverage and models.

    Success is a status below 400 here; visible is none or below 300. Cells of the facts do too if they have their ``stated_tokens``.
    """
    w, total, cost = (F.col("requests"), "stated_tokens", "cost") if is_measured(dated) else (_weight(), "total_tokens", "estimated_cost")
    status = F.col("status_code")
    visible, success = status.isNull() | (status < 300), status < 400
    kinds = {"": None, "visible_": visible, "success_": success}
    local = F.col("coverage_origin") == LOCAL_ONLY
    sums = [_sum(w, when).alias(f"{k}requests") for k, when in kinds.items()]
    sums += [_sum(F.col(total if c == "total_tokens" else c), when).alias(f"{k}{c}") for k, when in kinds.items() for c in ("total_tokens", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")]
    sums += [_sum(F.col(cost), when, 0.0).alias(f"{k}cost") for k, when in kinds.items()]
    named = F.when(F.trim("model") != "", F.col("model"))
    out = dated.groupBy("local_date", *by).agg(
        *sums,
        _sum(w, (status >= 400) & (status < 500)).alias("client_errors"),
        _sum(w, status >= 500).alias("server_errors"),
        _sum(w, ~local).alias("proxy_backed"),
        _sum(w, local).alias("local_only"),
        _sum(w, F.col("coverage_origin") == MERGED).alias("overlap"),
        *([] if by else [F.count_distinct(named).alias("models"), F.count_distinct(F.when(success, named)).alias("success_models")]),
    )
    return out.withColumn("is_partial", (F.col("proxy_backed") > 0) & (F.col("local_only") > 0))


def ranked_shares(metrics: DataFrame, value: str = "total_tokens", name: str = "percent") -> DataFrame:
    """Each row's percent of all rows' ``value``. The rows are a report's groups: models, tools or sources."""
    return metrics.withColumn(name, percent(F.col(value), F.sum(value).over(Window.partitionBy())))
