"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5: such rows are never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most ``per_class`` labelled documents of each class 0 and 1, and how many there are of each.

    Those whose id has the least hash are taken, so that the bound is exact and the choice depends on the data alone. An
    id that is labelled twice has its least label, and one that stands for several texts that with the least hash. Rows
    that are held out, or lack an id, a text or a label of 0 or 1 are not learned from.
    """
    hashed = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30))
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in usable.groupBy("_label").count().collect()}
    share = F.lit(0.0)
    for c, n in counts.items():
        share = F.when(F.col("_label") == c, min(1.0, (per_class + 10 * per_class**0.5 + 100) / n)).otherwise(share)
    likely = usable.where(hashed < share * float(1 << 30)).groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = [likely.where(F.col("_label") == c).orderBy(hashed, "_id").limit(per_class) for c in (0, 1)]
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
    # at most 2 * per_class rows are broadcast
    found = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id")
    return found.groupBy("_id", "_label").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")).select("_text", "_label"), counts
