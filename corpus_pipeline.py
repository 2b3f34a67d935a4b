"""A corpus cleaned and packed for training, stage by stage.

Each stage works on all that the one before it kept and its decisions take effect: rejected documents go, near-duplicates
but for one go, secrets are replaced in the text, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.jaccard_dedup import one_of_each_alike
from meterlake.llm.language_id import UNKNOWN, identify_languages
from meterlake.llm.packing import pack_documents
from meterlake.llm.quality_rules import judge_quality
from meterlake.llm.scratch import table
from meterlake.llm.secret_scan import redact_secrets

#: A text is rejected if the language of most of its letters has less than this share of them.
LEAST_LANGUAGE_SHARE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the fitted classifier keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_quality(docs, labels, keep=tuple(docs.columns)).where("kept").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are mostly in one learned language."""
    found = identify_languages(docs, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Close fingerprints are linked, and so are sets of five-word shingles of a similarity of 0.8 or more.
    """
    return one_of_each_alike(docs).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for each secret."""
    clean = redact_secrets(docs.withColumn("_before", F.length("text")))
    length = F.length("text").cast("long")
    return clean.withColumn("n_chars", F.when(length == F.col("_before"), F.col("n_chars")).otherwise(length)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("packing", packing),
]
#: Models are fitted on the way and the last stage tokenizes: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
