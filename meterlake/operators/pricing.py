"""Prices: catalogues, the best price for a model, and the cost of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.models import match_score
from meterlake.functions.numbers import cost

_PRICE_COLUMNS = ("input_price", "output_price", "cache_read_price", "cache_write_price")


def _custom_first(source: Column) -> Column:
    return F.when(source == "custom", 0).otherwise(1)


def catalogue(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """Both lists, in this order; on ties the earlier row wins."""
    return configured.withColumn("_list", F.lit(0)).unionByName(stored.withColumn("_list", F.lit(1)), allowMissingColumns=True).withColumn("rank", F.col("_list") * 1_000_000 + F.coalesce("rank", F.lit(0))).drop("_list")


def priced_models(models: DataFrame, prices: DataFrame, model: str = "model", exact: bool = False) -> DataFrame:
    """(model, price columns, price_id) of each distinct model that some price fits.

    Exact: equal ids. Else the least score, then custom prices, then the order of the list. Models are made distinct
    first, and prices are a dimension table: each distinct model meets each price once, in a broadcast join whose size
    is checked by the optimizer.
    """
    names = models.select(model).distinct()
    offered = prices.select("model_id", "source", "rank", *_PRICE_COLUMNS)
    score = F.when(F.col(model) == F.col("model_id"), 0) if exact else match_score(F.col(model), F.col("model_id"))
    met = names.join(offered, F.col(model) == F.col("model_id")) if exact else names.join(offered, score.isNotNull())
    order = F.struct(score, _custom_first(F.col("source")), F.coalesce("rank", F.lit(0)), "model_id")
    best = met.groupBy(model).agg(F.min_by(F.struct("model_id", *_PRICE_COLUMNS), order).alias("_p"))
    return best.select(model, F.col("_p.model_id").alias("price_id"), *(F.col(f"_p.{c}").alias(c) for c in _PRICE_COLUMNS))


def with_cost(rows: DataFrame, prices: DataFrame, name: str = "cost", model: str = "model", exact: bool = False, models: DataFrame | None = None) -> DataFrame:
    """``rows`` with their cost at the best price of their model, 0 without one. The priced models, one row each, join back.

    ``models`` holds all models of the rows, maybe more: what ``rows`` are computed from, so that they aren't computed twice.
    """
    best = priced_models(rows if models is None else models, prices, model, exact)
    named = best.select(F.col(model).alias("_model"), *(F.col(c).alias(f"_{c}") for c in _PRICE_COLUMNS))
    value = cost(*(F.col(c) for c in ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")), *(F.col(f"_{c}") for c in ("input_price", "output_price", "cache_read_price", "cache_write_price")))
    return rows.join(named, F.col(model) == F.col("_model"), "left").select(*rows.columns, value.alias(name))


def search(prices: DataFrame, matches: Column, limit: int, offset: int = 0) -> DataFrame:
    return prices.where(matches).orderBy("model_id").offset(offset).limit(limit)


def upserted(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each model: a custom price stays whatever a sync brings, else the newer row stands."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("model_id").orderBy(F.when(F.col("_new") == 1, _custom_first(F.col("source")) * 2).otherwise(_custom_first(F.col("source")) * 2 + 1), F.desc("last_updated"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def newest_prices(offers: DataFrame) -> DataFrame:
    """Of each model id the offer updated last (ties: the first provider), if it has a price at all."""
    sound = offers.where((F.coalesce("input_price", F.lit(0.0)) > 0) | (F.coalesce("output_price", F.lit(0.0)) > 0))
    order = Window.partitionBy("model_id").orderBy(F.desc_nulls_last("last_updated"), "provider")
    return sound.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def frozen_costs(records: DataFrame, prices: DataFrame, exact: bool = False) -> DataFrame:
    """``records`` with the cost of unlocked rows computed and locked; locked rows stay as they are."""
    return with_cost(records, prices, "_now", exact=exact).withColumns({"estimated_cost": F.when(F.col("cost_locked"), F.col("estimated_cost")).otherwise(F.col("_now")), "cost_locked": F.lit(True)}).drop("_now")


def preview_repricing(records: DataFrame, chosen: Column) -> DataFrame:
    """(model, n_records, current_cost) of what a new price would change, the most rows first."""
    return records.where(chosen).groupBy("model").agg(F.count("*").alias("n_records"), F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("current_cost")).orderBy(F.desc("n_records"), "model")


def repriced_records(records: DataFrame, chosen: Column, price: dict[str, float | None]) -> DataFrame:
    """``records`` with the chosen rows at one price, and locked."""
    at = [F.lit(price.get(c)).cast("double") for c in ("input_price", "output_price", "cache_read_price", "cache_write_price")]
    value = cost(*(F.col(c) for c in ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")), *at)
    hit = F.coalesce(chosen, F.lit(False))
    return records.withColumns({"_hit": hit}).withColumns({"estimated_cost": F.when(F.col("_hit"), value).otherwise(F.col("estimated_cost")), "cost_locked": F.col("_hit") | F.col("cost_locked")}).drop("_hit")
