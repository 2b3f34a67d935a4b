"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.scratch import checkpoint


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least("src", F.min("dst")).alias("low"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(least.select("src", F.col("low").alias("dst"))).where("src > dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (src, dst); component is the smallest node reachable.

    Null ends, loops and repeated edges are ignored; no edges give no rows. A node's edges are only ever reduced by
    ``min`` (with map-side partial aggregation) or joined (AQE splits a hot node), so that a hub never gathers in one task.
    Each round ends in a checkpoint. Rounds grow with the logarithm of the longest chain; running out of them is an error.
    """
    clean = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    clean = checkpoint(clean.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = _signature(clean)
    if before[0]:
        for _ in range(max_rounds):
            clean = checkpoint(_small_star(_large_star(clean)))
            now = _signature(clean)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = clean.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return clean.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
