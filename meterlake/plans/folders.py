"""Folders of a shared file system, as Spark itself sees them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def make(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.mkdirs(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, place = _place(spark, path)
    fs.rename(place, _place(spark, to)[1])


def complete(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers behind ``prefix`` of the folders that were written to the end, in order."""
    found = [int(n.removeprefix(prefix)) for n in children(spark, path) if n.startswith(prefix)]
    return [n for n in found if exists(spark, f"{path}/{prefix}{n:012d}/_SUCCESS")]


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """A path that is removed when the application ends, whatever it holds then."""
    fs, place = _place(spark, path)
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path
