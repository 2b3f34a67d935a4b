"""The statistics report: totals, trend, models, performance and insights of a time range.

Every function takes facts, or ``cells`` of them: metrics by bucket, model, status and coverage, from which all of the report
follows without going over the facts again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.calendar import bucket_label, bucket_spine, bucket_start
from meterlake.functions.numbers import percent
from meterlake.operators.metrics import added_up, averages, fact_metrics, measured, measures, ranked_shares

METRIC = {"tokens": "total_tokens", "cost": "cost", "requests": "requests"}
TREND_MODELS, DISTRIBUTION_MODELS, INSIGHTS = 6, 5, 4


def cells(facts: DataFrame, step: int, tz: str = "UTC", *by: str, more: Sequence[Column] = ()) -> DataFrame:
    """Metrics, and the number of facts, by bucket, model, status and coverage: a report's whole input, whatever the number of facts. ``more`` are further aggregates."""
    return _bucketed(facts, step, tz).groupBy(*by, "bucket_start", "model", "status_code", "coverage_origin").agg(*fact_metrics(), F.count("*").alias("facts"), *more)


def _bucketed(rows: DataFrame, step: int, tz: str) -> DataFrame:
    return rows if "bucket_start" in rows.columns else rows.withColumn("bucket_start", bucket_start(F.col("timestamp_sec"), step, tz))


def totals(facts: DataFrame) -> DataFrame:
    m = measures(facts)
    return m.select("requests", "local_requests", "proxy_requests", "total_tokens", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens", "cost", "success_requests", (F.col("client_errors") + F.col("server_errors")).alias("error_requests"))


def model_table(facts: DataFrame) -> DataFrame:
    """Models by tokens, with their percent of all tokens."""
    m = ranked_shares(measures(facts, "model"))
    return m.select("model", "requests", "total_tokens", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens", "cost", "percent", "success_requests", (F.col("client_errors") + F.col("server_errors")).alias("error_requests"), *averages()).orderBy(F.desc("total_tokens"), "model")


_COUNTED = ("requests", "total_tokens", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens", "cost")


def trend(facts: DataFrame, start: int, end: int, step: int, tz: str = "UTC") -> DataFrame:
    """Every bucket of the range in order, zeros where nothing happened."""
    found = measures(_bucketed(facts, step, tz), "bucket_start")
    filled = bucket_spine(facts.sparkSession, start, end, step, tz).join(found, "bucket_start", "left").fillna(0, list(_COUNTED))
    return filled.select("bucket_start", bucket_label(F.col("bucket_start"), step, tz).alias("label"), *_COUNTED).orderBy("bucket_start")


def model_trends(facts: DataFrame, start: int, end: int, step: int, tz: str = "UTC", n: int = TREND_MODELS) -> DataFrame:
    """Trends of the ``n`` models of most tokens, every bucket of the range for each.

    A model's buckets, as many as the range has at most, lie in a map while the models are ranked.
    """
    found = measures(_bucketed(facts, step, tz), "bucket_start", "model")
    at = F.map_from_entries(F.collect_list(F.struct("bucket_start", F.struct(*_COUNTED))))
    best = found.groupBy("model").agg(F.sum("total_tokens").alias("_all"), at.alias("_at")).orderBy(F.desc("_all"), "model").limit(n)
    pairs = best.join(F.broadcast(bucket_spine(facts.sparkSession, start, end, step, tz)), F.lit(True)).withColumn("_m", F.try_element_at("_at", F.col("bucket_start")))
    filled = pairs.select("bucket_start", bucket_label(F.col("bucket_start"), step, tz).alias("label"), "model", *(F.col(f"_m.{c}").alias(c) for c in _COUNTED))
    return filled.fillna(0, list(_COUNTED)).orderBy("bucket_start", "model")


def performance(facts: DataFrame) -> DataFrame:
    """One row: sample-weighted means, the fastest model by rate, the slowest by first token, and the number of samples."""
    by_model = measures(facts, "model").select("model", *averages(), "rate_sum", "rate_count", "ttft_sum", "ttft_count")
    out = by_model.agg(
        F.coalesce(F.try_divide(F.sum("rate_sum"), F.sum("rate_count")), F.lit(0.0)).alias("avg_rate"),
        F.coalesce(F.try_divide(F.sum("ttft_sum").cast("double"), F.sum("ttft_count")), F.lit(0.0)).alias("avg_ttft_ms"),
        F.max_by("model", F.when(F.col("avg_rate").isNotNull(), F.struct("avg_rate", "model"))).alias("fastest_model"),
        F.max_by("model", F.when(F.col("avg_ttft_ms").isNotNull(), F.struct("avg_ttft_ms", "model"))).alias("slowest_model"),
        F.greatest(F.coalesce(F.sum("rate_count"), F.lit(0)), F.coalesce(F.sum("ttft_count"), F.lit(0))).alias("samples"),
    )
    return out


def mean_of_model_means(by_model: DataFrame) -> DataFrame:
    """The other average, where each model counts once whatever its samples."""
    return by_model.agg(F.avg("avg_rate").alias("avg_rate"), F.avg("avg_ttft_ms").alias("avg_ttft_ms"))


def insights(facts: DataFrame, step: int, metric: str = "tokens", tz: str = "UTC") -> DataFrame:
    """At most four rows (kind, level, value, model, date): peak bucket, top model, errors, slowest model."""
    value = METRIC[metric]
    shown = F.format_string("%.4f", value) if metric == "cost" else F.col(value).cast("string")
    # buckets, models and the whole, in one pass over the cells
    found = measures(_bucketed(facts, step, tz), "bucket_start", "model")
    sets = found.groupingSets([["bucket_start"], ["model"], []], "bucket_start", "model").agg(F.grouping_id().alias("_g"), *added_up())
    bucket, model, whole = F.col("_g") == 1, F.col("_g") == 2, F.col("_g") == 3
    ttft = F.try_divide(F.col("ttft_sum").cast("double"), F.col("ttft_count"))
    one = sets.groupBy().agg(
        F.max_by(F.struct(shown.alias("shown"), bucket_label(F.col("bucket_start"), step, tz).alias("label")), F.when(bucket & (F.col(value) > 0), F.struct(value, "bucket_start"))).alias("peak"),
        F.min_by(F.struct("model", "total_tokens"), F.when(model, F.struct(-F.col("total_tokens"), "model"))).alias("best"),
        F.max(F.when(whole, F.col("total_tokens"))).alias("total"),
        F.max(F.when(whole, F.col("client_errors") + F.col("server_errors"))).alias("errors"),
        F.max_by("model", F.when(model & ttft.isNotNull(), F.struct(ttft, "model"))).alias("slowest"),
        F.max(F.when(whole, ttft)).alias("ttft"),
    )

    def row(place: int, kind: str, level: str, when: Column, text: Column, model: Column | None = None, date: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.when(when, F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.lit(level).alias("level"), text.alias("value"), (none if model is None else model).alias("model"), (none if date is None else date).alias("date")))

    rows = F.array_compact(
        F.array(
            row(1, "peak", "info", F.col("peak").isNotNull(), F.col("peak.shown"), date=F.col("peak.label")),
            row(2, "topModel", "info", F.col("best").isNotNull(), F.format_string("%.1f", percent(F.col("best.total_tokens"), F.col("total"))), F.col("best.model")),
            row(3, "errors", "warning", F.col("errors") > 0, F.col("errors").cast("string")),
            row(4, "slowestModel", "info", F.col("slowest").isNotNull(), F.format_string("%.0f", "ttft"), F.col("slowest")),
        )
    )
    return one.select(F.explode(rows).alias("x")).select("x.*").orderBy("place").limit(INSIGHTS)


def distribution(facts: DataFrame, n: int = DISTRIBUTION_MODELS) -> DataFrame:
    """The ``n`` models of most tokens with their percent of all models' tokens; what can't be named is left out."""
    named = measures(facts.where("model <> 'unknown'"), "model").select("model", "total_tokens", "requests")
    return ranked_shares(named).orderBy(F.desc("total_tokens"), "model").limit(n)


def ranking(facts: DataFrame, *by: str) -> DataFrame:
    """Groups by tokens, then requests. Percent is of cost if anything cost, else of tokens, else of requests."""
    m = measured(facts, *by)
    whole = Window.partitionBy()
    share = (
        F.when(F.sum("cost").over(whole) > 0, percent(F.col("cost"), F.sum("cost").over(whole)))
        .when(F.sum("total_tokens").over(whole) > 0, percent(F.col("total_tokens"), F.sum("total_tokens").over(whole)))
        .otherwise(percent(F.col("requests"), F.sum("requests").over(whole)))
    )
    known = F.col("status_facts") > 0
    return m.select(*by, "requests", "total_tokens", "cost", share.alias("percent"), F.when(known, F.col("success_requests")).alias("success_requests"), F.when(known, F.col("client_errors") + F.col("server_errors")).alias("error_requests"), *averages(), "last_seen_ms").orderBy(F.desc("total_tokens"), F.desc("requests"), *by)


def with_source(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """``facts`` with source_key and source_name: a configured source with this url and prefix (the first listed), else what the request shows."""
    from meterlake.functions.keys import host_label

    offered = sources.select(F.explode("api_key_prefixes").alias("_prefix"), F.coalesce("base_url", F.lit("")).alias("_url"), F.struct("rank", "id", F.coalesce("display_name", "id").alias("name")).alias("_s"))
    first = offered.groupBy("_prefix", "_url").agg(F.min("_s").alias("_s"))
    joined = facts.join(first, (F.col("api_key_prefix") == F.col("_prefix")) & (F.coalesce("request_base_url", F.lit("")) == F.col("_url")), "left")
    shown = F.when(F.col("api_key_prefix").isNull() & F.col("request_base_url").isNull(), "local").otherwise(host_label(F.col("request_base_url")))
    return joined.select(*facts.columns, F.coalesce("_s.id", shown).alias("source_key"), F.coalesce("_s.name", shown).alias("source_name"))


def rates_by_model(facts: DataFrame) -> DataFrame:
    """Models by mean rate, fastest first."""
    m = measured(facts.where(F.trim("model") != ""), "model").where("rate_count > 0")
    return m.select("model", F.col("rate_count").alias("requests"), "rate_tokens", "rate_ms", (F.col("rate_sum") / F.col("rate_count")).alias("avg_rate"), "min_rate", "max_rate").orderBy(F.desc("avg_rate"), "model")


def first_tokens_by_model(facts: DataFrame) -> DataFrame:
    """Models by mean time to the first token, quickest first; nothing at all where no request has a rate."""
    rated = facts.where("duration_ms > 0 AND output_tokens_per_second > 0").limit(1).select(F.lit(True).alias("_any"))
    m = measured(facts.where(F.trim("model") != ""), "model").where("ttft_count > 0").join(F.broadcast(rated), F.lit(True))
    return m.select("model", F.col("ttft_count").alias("requests"), (F.col("ttft_sum") / F.col("ttft_count")).alias("avg_ttft_ms"), "min_ttft_ms", "max_ttft_ms").orderBy("avg_ttft_ms", "model")


def overall_rate(facts: DataFrame) -> DataFrame:
    m = measured(facts)
    rate, ttft = (F.coalesce(c, F.lit(0.0)) for c in (F.try_divide("rate_sum", "rate_count"), F.try_divide(F.col("ttft_sum").cast("double"), F.col("ttft_count"))))
    some = F.col("rate_count") > 0
    return m.select(F.col("rate_count").alias("requests"), "rate_tokens", "rate_ms", rate.alias("avg_rate"), F.when(some, F.col("ttft_count")).otherwise(0).alias("ttft_requests"), F.when(some, ttft).otherwise(0.0).alias("avg_ttft_ms"))


_WINDOW = ("requests", "total_tokens", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens", "cost", "success_requests", "client_errors", "server_errors")


def _every_window(found: DataFrame, windows: dict[str, int]) -> DataFrame:
    every = found.sparkSession.createDataFrame([(n,) for n in windows], "window string")
    return F.broadcast(every).join(found, "window", "left").fillna(0, list(_WINDOW))


def windowed(facts: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Each fact once for every window that it lies in."""
    names = F.array(*(F.struct(F.lit(n).alias("window"), F.lit(s).cast("long").alias("since")) for n, s in windows.items()))
    inside = facts.where(F.col("timestamp_sec") >= min(windows.values()))
    return inside.withColumn("window", F.explode(F.transform(F.filter(names, lambda x: x["since"] <= F.col("timestamp_sec")), lambda x: x["window"])))


def usage_of_windows(rows: DataFrame, windows: dict[str, int]) -> DataFrame:
    """(window, metrics) of facts or cells that say which window they count in."""
    return _every_window(measures(rows, "window").select("window", *_WINDOW, F.try_divide("rate_sum", "rate_count").alias("avg_rate")), windows)


def window_usage(facts: DataFrame, windows: dict[str, int]) -> DataFrame:
    """(window, metrics) of each named window that begins at the given second: one pass, each fact in every window it belongs to."""
    return usage_of_windows(windowed(facts, windows), windows)


def window_models(rows: DataFrame) -> DataFrame:
    """Requests, tokens and cost of each window by model."""
    return measures(rows, "window", "model").select("window", "model", "requests", "total_tokens", "cost").orderBy("window", F.desc("total_tokens"), "model")


def ratio_rate(facts: DataFrame) -> DataFrame:
    """The window's rate as all tokens over all time, and requests by status class."""
    rated = (F.col("duration_ms") > 0) & (F.col("output_tokens") > 0)
    return facts.where(rated).agg(F.count("*").alias("requests"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("rate_tokens"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("rate_ms"), F.coalesce(F.try_divide(F.sum("output_tokens") * 1000.0, F.sum("duration_ms")), F.lit(0.0)).alias("tokens_per_second"))


def with_tool_profile(ranking: DataFrame, profiles: DataFrame) -> DataFrame:
    """A ranking by tool with the label and icon of the tool's profile (tool, display_name, icon), of repeated ones the first by name; without one the label is the tool, or ``__unknown__``."""
    shown = profiles.groupBy("tool").agg(F.min(F.struct("display_name", "icon")).alias("_p"))
    own = F.when(F.trim("tool") == "", "__unknown__").otherwise(F.col("tool"))
    return ranking.join(F.broadcast(shown), "tool", "left").select(*ranking.columns, F.coalesce("_p.display_name", own).alias("label"), F.col("_p.icon").alias("icon"))


def window_requests(records: DataFrame, since_ms: int, until_ms: int) -> DataFrame:
    """One row of a proxy window: requests, tokens and cost of all records, and of those below 300 alone."""
    inside = records.where((F.col("timestamp") >= since_ms) & (F.col("timestamp") < until_ms))
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_create_tokens") + F.col("cache_read_tokens")
    kinds = {"": F.lit(True), "visible_": F.col("status_code") < 300}
    sums = [F.coalesce(F.sum(F.when(when, value)), F.lit(zero)).alias(f"{k}{name}") for k, when in kinds.items() for name, value, zero in (("requests", F.lit(1).cast("long"), 0), ("total_tokens", tokens, 0), ("cost", F.col("estimated_cost"), 0.0))]
    return inside.agg(*sums)
