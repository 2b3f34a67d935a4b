"""All sources behind one interface: what lies there, what has changed since the last look, and the requests of that."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators.filters import after_key
from meterlake.operators.maintenance import changed_keys
from meterlake.plans import folders
from meterlake.schemas import LOCAL
from meterlake.sources import transcripts
from meterlake.sources.files import file_stem, root_session

#: Group of a source whose files name their sessions themselves: which file a session is in is only known once it is parsed.
WHOLE = "*"


@dataclass(frozen=True)
class Source:
    """A tool's files. ``session`` gives a file's session by its path; without it all files are one group."""

    tool: str
    glob: str
    reader: Callable[..., DataFrame]
    session: Callable[[Column], Column] | None = None

    def scan(self, spark: SparkSession, roots: Sequence[str]) -> DataFrame:
        """(session_id, fingerprint, paths) of each group of files, none of which is opened."""
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", self.glob).load(list(roots))
        # readers name sessions by the same text of the path
        group = self.session(F.col("_metadata.file_path")) if self.session else F.lit(WHOLE)
        own = found.select(group.alias("session_id"), "path", F.xxhash64("path", "length", F.unix_micros("modificationTime")).alias("_h"))
        return own.groupBy("session_id").agg(F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("fingerprint"), F.collect_list("path").alias("paths"))

    def parse(self, spark: SparkSession, paths: Sequence[str]) -> DataFrame:
        """LOCAL requests of files or folders."""
        return self.reader(spark, list(paths), tool=self.tool)

    def group_of(self) -> Column:
        """The group that a request belongs to."""
        return F.col("session_id") if self.session else F.lit(WHOLE)


#: The sources that are files, by tool.
SOURCES = {
    s.tool: s
    for s in (
        Source("claude_code", "*.jsonl", transcripts.assistant_lines, root_session),
        Source("codex", "*.jsonl", transcripts.rollout_lines),
        Source("gemini", "*.json", transcripts.chat_documents),
        Source("copilot_cli", "*.jsonl", transcripts.shutdown_totals),
        Source("openclaw", "*.jsonl*", transcripts.agent_lines, file_stem),
        Source("qoder_cli", "*.jsonl", transcripts.assistant_lines, root_session),
        Source("qoder_work", "*.log", transcripts.log_lines),
        Source("opencode", "*.json", transcripts.message_documents),
    )
}

_SEEN = "session_id string, fingerprint string, bucket int, version long"


class ScanCache:
    """A source's requests as last parsed. A refresh opens the files of groups that are new or have changed, and no others.

    Requests lie in partitions named by a bucket of groups and a version. The list of groups (fingerprint, bucket, the
    bucket's version) is written last, under the next number: readers see a refresh entirely or not at all. Groups whose
    files are gone leave.
    """

    def __init__(self, spark: SparkSession, path: str, source: Source, buckets: int = 64):
        self.spark, self.path, self.source, self.buckets = spark, path.rstrip("/"), source, buckets

    def _version(self) -> int:
        return (folders.complete(self.spark, f"{self.path}/seen", "v=") or [0])[-1]

    def seen(self) -> DataFrame:
        at = self._version()
        return self.spark.read.schema(_SEEN).parquet(f"{self.path}/seen/v={at:012d}") if at else self.spark.createDataFrame([], _SEEN)

    def read(self) -> DataFrame:
        """LOCAL requests of all groups."""
        parts = [f"b{r.bucket}.{r.version}" for r in self.seen().select("bucket", "version").distinct().collect()]
        if not parts or not folders.exists(self.spark, f"{self.path}/requests"):
            return self.spark.createDataFrame([], LOCAL)
        return self.spark.read.parquet(f"{self.path}/requests").where(F.col("part").isin(parts)).select(LOCAL.fieldNames())

    def refresh(self, roots: Sequence[str]) -> dict[str, int]:
        """Brings the requests up to date with the files under the roots; gives the number of groups by kind of change.

        The paths of changed files go through the driver, as those of any list of files that Spark is to read do.
        """
        now, old = self.source.scan(self.spark, roots).persist(), self.seen()
        change = changed_keys(old, now, "session_id", "fingerprint").withColumn("bucket", self._bucket(F.col("session_id"))).persist()
        try:
            counts = {r.change: r["n"] for r in change.groupBy("change").agg(F.count("*").alias("n")).collect()}
            if counts:
                self._rewrite(now, old, change)
        finally:
            now.unpersist()
            change.unpersist()
        return counts

    def _bucket(self, group: Column) -> Column:
        return F.pmod(F.xxhash64(group), F.lit(self.buckets)).cast("int")

    def _rewrite(self, now: DataFrame, old: DataFrame, change: DataFrame) -> None:
        version = self._version() + 1
        touched = [r.bucket for r in change.select("bucket").distinct().collect()]
        paths = [r.path for r in now.join(change.where("change <> 'removed'"), "session_id", "left_semi").select(F.explode("paths").alias("path")).collect()]
        group = self.source.group_of()
        rows = self.read().where(self._bucket(group).isin(touched)).withColumn("_group", group).join(change.select(F.col("session_id").alias("_group")), "_group", "left_anti").select(LOCAL.fieldNames())
        if paths:
            rows = rows.unionByName(self.source.parse(self.spark, paths))
        part = F.concat(F.lit("b"), self._bucket(group), F.lit(f".{version}"))
        rows.withColumn("part", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/requests")
        groups = now.select("session_id", "fingerprint", self._bucket(F.col("session_id")).alias("bucket"))
        kept = old.select("bucket", "version").distinct()
        listed = groups.join(kept, "bucket", "left").select("session_id", "fingerprint", "bucket", F.when(F.col("bucket").isin(touched), F.lit(version)).otherwise(F.col("version")).cast("long").alias("version"))
        listed.write.mode("overwrite").parquet(f"{self.path}/seen/v={version:012d}")
        self._clear(version, touched)

    def _clear(self, version: int, touched: Sequence[int]) -> None:
        """What neither this list of groups nor the one before it names goes."""
        for n in folders.complete(self.spark, f"{self.path}/seen", "v=")[:-2]:
            folders.remove(self.spark, f"{self.path}/seen/v={n:012d}")
        live = {f"part=b{r.bucket}.{r.version}" for n in (version - 1, version) if n for r in self.spark.read.schema(_SEEN).parquet(f"{self.path}/seen/v={n:012d}").select("bucket", "version").distinct().collect()}
        for name in folders.children(self.spark, f"{self.path}/requests"):
            if name.startswith("part=") and name not in live:
                folders.remove(self.spark, f"{self.path}/requests/{name}")


@dataclass(frozen=True)
class Unread:
    """Rows to take in; whether those are all that there are; the last (time, row) among all rows, None of an empty table; the table's shape."""

    rows: DataFrame
    whole: bool
    end: tuple[int, str] | None
    shape: str


class KeysetCheckpoint:
    """How far a growing table of someone else's has been read: the last (time, row), and what the table looked like then. Rows are numbers or texts.

    A read gives the rows behind the checkpoint. It gives all rows if there is no checkpoint, the table's shape has changed
    or its end lies before the checkpoint, and each ``full_every``-th time, for what has changed in rows already read.
    """

    _STATE = "last_time long, last_row string, shape string, reads long"

    def __init__(self, spark: SparkSession, path: str, time: str = "time_updated", row: str = "id", full_every: int = 100):
        self.spark, self.path, self.time, self.row, self.full_every = spark, path.rstrip("/"), time, row, full_every

    def _numbers(self) -> list[int]:
        return folders.complete(self.spark, self.path, "v=")

    def state(self):
        """The checkpoint, None without any."""
        have = self._numbers()
        return self.spark.read.schema(self._STATE).json(f"{self.path}/v={have[-1]:012d}").first() if have else None

    def _end(self, rows: DataFrame):
        return rows.agg(F.max(F.struct(F.col(self.time).cast("long").alias("t"), F.col(self.row).alias("r"))).alias("end")).first().end

    def unread(self, rows: DataFrame) -> Unread:
        """What is to be taken in, up to the end that the table has now: what arrives later is left to the next read, whenever the rows are read."""
        at, end = self.state(), self._end(rows)
        if end is None:
            return Unread(rows.where(F.lit(False)), True, None, rows.schema.simpleString())
        time, row = F.col(self.time).cast("long"), F.col(self.row)
        whole = at is None or at.shape != rows.schema.simpleString() or at.reads % self.full_every == 0 or (end.t, end.r) < (at.last_time, type(end.r)(at.last_row))
        # rows without a time or a name lie before any end
        found = rows.where(F.coalesce(~after_key(time, row, end.t, end.r), F.lit(True)))
        if not whole:
            found = found.where(after_key(time, row, at.last_time, type(end.r)(at.last_row)))
        return Unread(found, whole, (end.t, str(end.r)), rows.schema.simpleString())

    def advance(self, taken: Unread) -> None:
        """Once the rows of a read have been taken in: the next read goes on behind the end that they were bounded by."""
        at, have = self.state(), self._numbers()
        if taken.end is None:
            return
        new = self.spark.createDataFrame([(*taken.end, taken.shape, (at.reads if at else 0) + 1)], self._STATE)
        new.coalesce(1).write.mode("overwrite").json(f"{self.path}/v={(have or [0])[-1] + 1:012d}")
        for n in have[:-1]:
            folders.remove(self.spark, f"{self.path}/v={n:012d}")
