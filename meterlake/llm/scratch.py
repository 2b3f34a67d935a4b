"""Lineage cuts and intermediate tables in the folder that the whole cluster shares; they go when the application ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset: a folder in the warehouse (shared on a cluster), or, in local mode, a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    key = "meterlake.scratch.dir"
    if not (made := spark.conf.get(key, None)):
        spark.conf.set(key, made := tempfile.mkdtemp(prefix="meterlake-"))
    return made


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage; the rows lie in the shared folder and outlive any executor."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
        _gone_at_exit(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: for wide rows that are read more than once."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
