"""Files as rows: lines with their place, whole documents, and which files have changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST_BYTES = 100


def _placed(spark: SparkSession, paths: str | Sequence[str], glob: str, least_bytes: int) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(paths if isinstance(paths, str) else list(paths), lineSep="\n").where(F.col("_metadata.file_size") >= least_bytes)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.unix_timestamp("_metadata.file_modification_time").alias("modified"), place.alias("place"), "value")
    return named.select("path", "size", "modified", "place", F.regexp_replace("value", "\r$", "").alias("line"))


def lines(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.jsonl", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(path, size, modified, place, line) of every line that isn't blank. Files below ``least_bytes`` hold nothing yet.

    A large file is read in splits by many tasks. Places put the lines of a file in order: the start of the split, and the
    line's turn in it. They depend on how the file is cut and are good for nothing else.
    """
    return _placed(spark, paths, glob, least_bytes).where(F.trim("line") != "")


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.jsonl", least_bytes: int = LEAST_BYTES, wanted: Column | None = None) -> DataFrame:
    """``lines`` that are ``wanted``, with line_no: the number of lines before it in its file, blank and unwanted ones too.

    Lines are numbered in their split, and the counts of the splits before it are added. Of unwanted lines only the places
    are shuffled; of a split's lines one task counts the places, and of a file's one the wanted lines.
    """
    keep = F.trim("line") != ""
    rows = _placed(spark, paths, glob, least_bytes).withColumn("line", F.when(keep if wanted is None else keep & wanted, F.col("line")))
    split = Window.partitionBy("path", F.col("place.block"))
    rows = rows.withColumns({"_n": F.row_number().over(split.orderBy("place.at")) - 1, "_all": F.count("*").over(split)}).where("_n = 0 OR line IS NOT NULL")
    earlier = Window.partitionBy("path").orderBy("place.block").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("_n") == 0, F.col("_all"))).over(earlier), F.lit(0))
    return rows.withColumn("line_no", before + F.col("_n")).where("line IS NOT NULL").drop("_n", "_all")


def documents(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.json") -> DataFrame:
    """(path, size, modified, body) of whole files."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.unix_timestamp("_metadata.file_modification_time").alias("modified"), F.col("value").alias("body"))


def listed(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.jsonl") -> DataFrame:
    """(path, fingerprint) of files, without opening any."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths if isinstance(paths, str) else list(paths))
    return found.select("path", F.xxhash64("length", F.unix_timestamp("modificationTime")).alias("fingerprint"))


def fingerprints(rows: DataFrame) -> DataFrame:
    """(path, fingerprint) of the files that rows come from: size and time."""
    return rows.groupBy("path").agg(F.xxhash64(F.max("size"), F.max("modified")).alias("fingerprint"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def root_session(path: Column) -> Column:
    """A file in a ``subagents`` folder belongs to the session whose folder that is in."""
    return F.when(path.rlike(r"[/\\]subagents[/\\]"), F.regexp_extract(path, r"([^/\\]+)[/\\]subagents[/\\]", 1)).otherwise(file_stem(path))


def folder_project(path: Column) -> Column:
    """Project of a file under ``projects/<working folder with dashes for slashes>``: the last part of that name."""
    name = F.regexp_extract(F.translate(path, "\\", "/"), r"/projects/([^/]+)/", 1)
    return F.try_element_at(F.filter(F.split(name, "-"), lambda x: x != ""), F.lit(-1))


def wsl_distro(path: Column) -> Column:
    """Distribution of a UNC path into WSL, null elsewhere."""
    found = F.regexp_extract(F.translate(path, "\\", "/"), r"(?i)^//wsl(?:\$|\.localhost)/([^/]+)", 1)
    return F.when(found != "", found)


def wsl_roots(distros: Sequence[str], tails: Sequence[str], extra: Sequence[str] = ()) -> list[str]:
    """Every tail under every distribution, and roots given by hand, each once."""
    return list(dict.fromkeys([*(f"//wsl.localhost/{d}/{t.lstrip('/')}" for d in distros for t in tails), *extra]))


def last_good(current: DataFrame, previous: DataFrame, key: str = "path", parsed: str = "ok") -> DataFrame:
    """Rows that parse now; for files that don't, what they last held; files that are gone leave."""
    good = current.where(parsed)
    broken = current.where(~F.col(parsed)).select(key)
    return good.unionByName(previous.join(broken, key, "left_semi"), allowMissingColumns=True)
