"""Quotas of subscriptions and balances of relays, from the bodies of their services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.numbers import percent, window_name

_TIERS = "array<struct<name:string,utilization:double,used:double,quota:double,resets_at:string>>"


def _number(body: Column, path: str) -> Column:
    return F.get_json_object(body, path).try_cast("double")


def _tier(name: Column | str, used: Column, quota: Column, resets: Column | None = None, utilization: Column | None = None) -> Column:
    share = percent(used, quota) if utilization is None else utilization
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).cast("string").alias("name"),
        share.cast("double").alias("utilization"),
        used.cast("double").alias("used"),
        quota.cast("double").alias("quota"),
        (F.lit(None) if resets is None else resets).cast("string").alias("resets_at"),
    )


def _windowed(body: Column) -> Column:
    """limits[]: a window in some unit, a limit and what remains; and usage at the top as the weekly window."""
    parsed = F.from_json(body, "usage struct<limit:string,remaining:string,resetTime:string>, limits array<struct<window:struct<duration:long,timeUnit:string>,detail:struct<limit:string,remaining:string,resetTime:string>>>")

    def number(c: Column) -> Column:
        return c.try_cast("double")  # some services quote their numbers

    unit = {"TIME_UNIT_MINUTE": 60, "TIME_UNIT_HOUR": 3600, "TIME_UNIT_DAY": 86_400}

    def seconds(w: Column) -> Column:
        out = F.lit(1)
        for name, n in unit.items():
            out = F.when(w["timeUnit"] == name, n).otherwise(out)
        return w["duration"] * out

    each = F.transform(F.coalesce(parsed["limits"], F.array().cast("array<struct<window:struct<duration:long,timeUnit:string>,detail:struct<limit:string,remaining:string,resetTime:string>>>")), lambda x: _tier(window_name(seconds(x["window"])), number(x["detail"]["limit"]) - number(x["detail"]["remaining"]), number(x["detail"]["limit"]), x["detail"]["resetTime"]))
    weekly = F.when(parsed["usage"].isNotNull(), F.array(_tier("weekly_limit", number(parsed["usage"]["limit"]) - number(parsed["usage"]["remaining"]), number(parsed["usage"]["limit"]), parsed["usage"]["resetTime"]))).otherwise(F.array().cast(_TIERS))
    return F.concat(each.cast(_TIERS), weekly.cast(_TIERS))


def relay_tiers(provider: Column, body: Column) -> Column:
    """Tiers (name, utilization in percent, used, quota, resets_at) from the body that a provider's service returns.

    Windowed services list limits; balance services give what is left and, some, what was granted; a service of percentages
    gives them as they are. A body that doesn't parse has no tiers.
    """

    def balance(left: str, total: str | None = None, used: str | None = None) -> Column:
        have = _number(body, left)
        quota = _number(body, total) if total else (have + _number(body, used) if used else have)
        spent = _number(body, used) if used else quota - have
        return F.when((have if total is None or used is None else quota).isNotNull(), F.array(_tier("balance", spent, quota))).otherwise(F.array().cast(_TIERS)).cast(_TIERS)

    percents = F.transform(F.from_json(F.get_json_object(body, "$.data.limits"), "array<struct<type:string,percentage:double,nextResetTime:string>>"), lambda x: _tier(x["type"], x["percentage"], F.lit(100.0), x["nextResetTime"], x["percentage"])).cast(_TIERS)
    counts = F.transform(F.from_json(F.get_json_object(body, "$.model_remains"), "array<struct<model_name:string,current_interval_total_count:double,current_interval_usage_count:double>>"), lambda x: _tier(x["model_name"], x["current_interval_usage_count"], x["current_interval_total_count"])).cast(_TIERS)
    by_provider = {
        "kimi": _windowed(body),
        "zhipu": percents,
        "minimax": counts,
        "zenmux": balance("$.data.remaining", "$.data.quota"),
        "deepseek": balance("$.balance_infos[0].total_balance"),
        "stepfun": balance("$.balance"),
        "siliconflow": balance("$.data.totalBalance"),
        "openrouter": balance("$.data.total_credits", "$.data.total_credits", "$.data.total_usage"),
        "novita": balance("$.availableBalance"),
    }
    out = F.array().cast(_TIERS)
    for name, tiers in by_provider.items():
        out = F.when(provider == name, F.coalesce(tiers, F.array().cast(_TIERS))).otherwise(out)
    return out


def lowest_remaining(buckets: DataFrame) -> DataFrame:
    """Of each model family the bucket with the least left: (family, model, remaining_fraction, utilization, resets_at)."""
    lower = F.lower("model")
    family = F.when(lower.contains("flash-lite"), "flash_lite").when(lower.contains("flash"), "flash").when(lower.contains("pro"), "pro").otherwise(lower)
    least = buckets.groupBy(family.alias("family")).agg(F.min_by(F.struct("model", "remaining_fraction", "resets_at"), F.struct("remaining_fraction", "model")).alias("x"))
    return least.select("family", "x.model", "x.remaining_fraction", ((1 - F.col("x.remaining_fraction")) * 100).alias("utilization"), "x.resets_at")
