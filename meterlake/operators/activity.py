"""Calendar activity: days of a month or year, zeros where nothing happened, and the history behind them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.calendar import business_date, date_spine, month_days
from meterlake.functions.numbers import heat_level
from meterlake.operators.metrics import _sum, _weight
from meterlake.operators.statistics import METRIC

_COUNTED = ("requests", "total_tokens", "cost", "models")


def day_activity(facts: DataFrame, tz: str = "UTC", boundary: int = 0) -> DataFrame:
    """(day, requests, total_tokens, cost, models) for each business day that has facts."""
    named = F.when(F.trim("model") != "", F.col("model"))
    return facts.groupBy(business_date(F.col("timestamp_sec"), tz, boundary).alias("day")).agg(_sum(_weight()).alias("requests"), _sum(F.col("total_tokens")).alias("total_tokens"), _sum(F.col("estimated_cost"), otherwise=0.0).alias("cost"), F.count_distinct(named).alias("models"))


def _calendar(days: DataFrame, first: date, last: date, metric: str) -> DataFrame:
    filled = date_spine(days.sparkSession, first, last).join(days, "day", "left").fillna(0, list(_COUNTED))
    from pyspark.sql import Window

    value = F.col(METRIC[metric])
    return filled.withColumn("level", heat_level(value, F.max(value).over(Window.partitionBy()))).withColumn("day", F.col("day").cast("string"))


def month_activity(days: DataFrame, year: int, month: int, metric: str = "tokens") -> DataFrame:
    return _calendar(days, *month_days(year, month), metric)


def year_activity(days: DataFrame, year: int, metric: str = "tokens") -> DataFrame:
    return _calendar(days, date(year, 1, 1), date(year, 12, 31), metric)


def with_hot_day(history: DataFrame, hot: DataFrame, today: date) -> DataFrame:
    """Stored days, today replaced by what is live."""
    return history.where(F.col("day") < F.lit(today)).unionByName(hot.where(F.col("day") >= F.lit(today)))


def calendar_grid(days: DataFrame, day: str = "day") -> DataFrame:
    """``days`` (whole months) with week row and weekday column of a grid whose weeks begin on Monday."""
    d = F.col(day).cast("date")
    first = F.trunc(d, "month")
    place = F.dayofmonth(d) - 1 + F.weekday(first)
    return days.withColumns({"week_row": F.floor(place / 7).cast("int"), "weekday": F.weekday(d), "blanks_before": F.weekday(first), "blanks_after": F.pmod(F.lit(6) - F.weekday(F.last_day(d)), F.lit(7))})


def history_days(facts: DataFrame, chosen: Column, tz: str = "UTC", boundary: int = 0) -> DataFrame:
    """Distinct business days of the chosen facts: what has to be built anew when they change."""
    return facts.where(chosen).select(business_date(F.col("timestamp_sec"), tz, boundary).alias("day")).distinct()
