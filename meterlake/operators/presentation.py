"""What a front end derives from reports, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.models import is_opaque
from meterlake.functions.numbers import heat_level, percent


def peak_point(trend: DataFrame, value: str = "total_tokens", at: str = "bucket_start") -> DataFrame:
    """The bucket of the most; of equal ones the first."""
    return trend.agg(F.max_by(F.struct(at, value), F.struct(F.col(value), -F.col(at))).alias("x")).select(f"x.{at}", f"x.{value}")


def direction(trend: DataFrame, value: str = "total_tokens", at: str = "bucket_start", band: float = 5.0) -> DataFrame:
    """Change from the first bucket to the last in percent (100 from nothing to something), and up, down or flat within a band."""
    ends = trend.agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))
    change = F.when(F.col("first_value") == 0, F.when(F.col("last_value") > 0, 100.0).otherwise(0.0)).otherwise(percent(F.col("last_value") - F.col("first_value"), F.col("first_value")))
    out = ends.withColumn("change", change)
    return out.withColumn("direction", F.when(F.col("change") > band, "up").when(F.col("change") < -band, "down").otherwise("flat"))


def leaders(models: DataFrame, n: int = 5) -> DataFrame:
    """Models with tokens and a telling name, the bar of each relative to the leader's, at least 4 percent."""
    shown = models.where((F.col("total_tokens") > 0) & ~is_opaque(F.col("model"))).orderBy(F.desc("total_tokens"), "model").limit(n)
    return shown.select("model", "total_tokens", F.greatest(F.lit(4.0), percent(F.col("total_tokens"), F.max("total_tokens").over(Window.partitionBy()))).alias("bar"))


def day_heat(trend: DataFrame, value: str = "total_tokens", at: str = "bucket_start") -> DataFrame:
    """Buckets gathered by day with a heat level, and how many days were active."""
    days = trend.groupBy(F.timestamp_seconds(at).cast("date").cast("string").alias("day")).agg(F.sum(value).alias(value))
    whole = Window.partitionBy()
    return days.withColumns({"level": heat_level(F.col(value), F.max(value).over(whole)), "active_days": F.count(F.when(F.col(value) > 0, 1)).over(whole)})


def resorted(ranking: DataFrame, metric: str = "cost", label: str = "model") -> DataFrame:
    """By the chosen metric, then cost, tokens, requests and the label; with the place."""
    order = [F.desc(metric), F.desc("cost"), F.desc("total_tokens"), F.desc("requests"), F.col(label)]
    return ranking.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order)))


def normalised(trend: DataFrame, *values: str) -> DataFrame:
    """Each series relative to its own maximum."""
    whole = Window.partitionBy()
    return trend.withColumns({f"{v}_share": F.coalesce(F.try_divide(F.col(v).cast("double"), F.max(v).over(whole)), F.lit(0.0)) for v in values})


def shown_models(models: DataFrame, n: int = 6) -> DataFrame:
    return models.where("percent > 0").orderBy(F.desc("percent"), "model").limit(n)


def display_input(i: Column, read: Column) -> Column:
    return i + read
