"""Inputs that lie in files. What a file holds of each day is learnt once, when the file is new or has changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.calendar import business_date
from meterlake.plans import folders
from meterlake.plans.materialize import content

_INDEX = "file string, path string, stamp string, run long, local_date string, n long, s decimal(38,0), first long, last long"
_HELD = "file string, local_date string, session_id string, n long, s decimal(38,0), first long, last long, run long"


def _name(path: Column) -> Column:
    """One spelling of local paths, which have one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


class FiledInput:
    """One side's rows in the files under ``roots``, with an index of what each file holds: number, content and span of its rows by day.

    ``load(paths)`` gives the rows of files, row by row (no shuffle, so that each row knows its file); ``seconds`` is the
    time of a row. A refresh lists the roots and opens the files whose length or time of change is not that of the index,
    no others. Sums over files are the sums that ``day_dependencies`` takes over all rows. An index of all files is written last,
    whole, under the next number: readers see a refresh entirely or not at all. Files without rows are indexed too. Rows
    without a time belong to no day. The paths of the files to open go through the driver, as any list of files to read does.
    """

    def __init__(self, spark: SparkSession, path: str, roots: Sequence[str], load: Callable[[list[str]], DataFrame], seconds: Column, tz: str = "UTC", boundary: int = 0):
        self.spark, self.path, self.roots, self.load = spark, path.rstrip("/"), list(roots), load
        self.seconds, self.tz, self.boundary = seconds, tz, boundary

    def listed(self) -> DataFrame:
        """(file, path, stamp) of all files under the roots; none is opened."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.roots)
        return files.select(_name(F.col("_metadata.file_path")).alias("file"), "path", F.concat_ws("/", "length", F.unix_micros("modificationTime")).alias("stamp"))

    def _versions(self) -> list[int]:
        return folders.complete(self.spark, f"{self.path}/index", "v=")

    def _at(self, version: int) -> DataFrame:
        return self.spark.read.schema(_INDEX).parquet(f"{self.path}/index/v={version:012d}")

    def index(self) -> DataFrame:
        """One row for each file and day on which it has rows, and one without a day for a file without rows."""
        have = self._versions()
        return self._at(have[-1]) if have else self.spark.createDataFrame([], _INDEX)

    def refresh(self) -> list[str]:
        """Opens new and changed files, forgets those that are gone, and gives the paths of the opened ones."""
        now, known = self.listed(), self.index()
        # stamps as they are before anything is read: a file that changes meanwhile is opened again next time
        new = now.join(known.select("file", "stamp").distinct(), ["file", "stamp"], "left_anti").select("file", "path", "stamp").collect()
        if not new and known.join(now, "file", "left_anti").isEmpty():
            return []
        run = (self._versions() or [0])[-1] + 1
        files = self.spark.createDataFrame(new, "file string, path string, stamp string")
        rows = known.join(now.select("file"), "file", "left_semi").join(files.select("file"), "file", "left_anti")
        paths = sorted(r.path for r in new)
        if paths:
            rows = rows.unionByName(self._opened(files, paths, run))
        rows.select(*(c.split()[0] for c in _INDEX.split(", "))).write.mode("overwrite").parquet(f"{self.path}/index/v={run:012d}")
        self._clear()
        return paths

    def _opened(self, files: DataFrame, paths: list[str], run: int) -> DataFrame:
        """Index rows of files that are read now. What they hold by session is written on the way."""
        rows = self.load(paths)
        marked = rows.select("*", _name(F.input_file_name()).alias("_file"), business_date(self.seconds, self.tz, self.boundary).alias("_day"), self.seconds.cast("long").alias("_at"))
        held = marked.groupBy(F.col("_file").alias("file"), "_day", "session_id").agg(F.count("*").alias("n"), content(rows).alias("s"), F.min("_at").alias("first"), F.max("_at").alias("last")).withColumn("local_date", F.col("_day").cast("string")).drop("_day")
        held.write.mode("overwrite").parquet(f"{self.path}/held/run={run}")
        kept = self.spark.read.schema(_HELD).parquet(f"{self.path}/held/run={run}")
        if not kept.join(files, "file", "left_anti").isEmpty():
            raise ValueError(f"rows of {self.path} don't name the files that they were read from")
        sums = kept.groupBy("file", "local_date").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.min("first").alias("first"), F.max("last").alias("last"))
        return files.withColumn("run", F.lit(run).cast("long")).join(sums, "file", "left")

    def _clear(self) -> None:
        """What neither this index nor the one before it names goes."""
        have = self._versions()
        for v in have[:-2]:
            folders.remove(self.spark, f"{self.path}/index/v={v:012d}")
        live = {f"run={r.run}" for v in have[-2:] for r in self._at(v).select("run").distinct().collect()}
        for name in folders.children(self.spark, f"{self.path}/held"):
            if name.startswith("run=") and name not in live:
                folders.remove(self.spark, f"{self.path}/held/{name}")

    def days(self) -> DataFrame:
        """(local_date, n, s): number and content of the rows by day, as the index knows them."""
        return self.index().where("n > 0").groupBy("local_date").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))

    def seen_sessions(self) -> DataFrame:
        """(local_date, session_id) of all rows, out of what is kept of the files."""
        live = self.index().where("n > 0").select("file", "run").distinct()
        if not folders.exists(self.spark, f"{self.path}/held"):
            return self.spark.createDataFrame([], "local_date string, session_id string")
        return self.spark.read.schema(_HELD).parquet(f"{self.path}/held").join(live, ["file", "run"], "left_semi").select("local_date", "session_id").distinct()

    def _of(self, wanted: Column) -> DataFrame:
        paths = sorted(r.path for r in self.index().where(wanted).select("path").distinct().collect())
        return self.load(paths) if paths else self.load([self.listed().first().path]).where(F.lit(False))

    def on_days(self, days: Sequence[str]) -> DataFrame:
        """All rows of the files that hold any of the days."""
        return self._of(F.col("local_date").isin(list(days)) if days else F.lit(False))

    def in_ranges(self, ranges: Sequence[tuple[int, int | None]]) -> DataFrame:
        """All rows of the files that reach into any range of seconds."""
        wanted = F.lit(False)
        for start, end in ranges:
            wanted = wanted | ((F.col("last") >= start) & (F.lit(True) if end is None else F.col("first") < end))
        return self._of(wanted)
