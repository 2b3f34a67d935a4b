"""Streams into stored tables: keyed replacement, days touched by late records, and the feed to other devices."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.operators.maintenance import latest_versions
from meterlake.plans import folders

DAY_MS = 86_400_000
KEY_BUCKETS = 16
_TOKENS = ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")


class RecordStore:
    """Records by key; one replaces the stored one of its key, whatever its day, if it has at least as many tokens.

    A batch is appended as a run of its own, dealt by a hash of the key and with a Bloom filter of the keys in each file: it
    writes what it holds, and nothing that is stored is rewritten for it. Readers merge the runs. Once ``fanout`` runs of a
    size stand at the end they become one of the next size, so that a row is rewritten as often as the logarithm of the
    number of batches. A run is named by the first and last batch in it; one that lies within another doesn't count, so
    that readers see a merge entirely or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "storage_dedupe_key", fanout: int = 8):
        self.spark, self.path, self.key, self.fanout = spark, path.rstrip("/"), key, fanout

    def runs(self) -> list[tuple[int, int]]:
        """(first, last) of the runs that count, in order."""
        names = [n.removeprefix("run=") for n in folders.children(self.spark, f"{self.path}/runs") if n.startswith("run=")]
        found = sorted(tuple(map(int, n.split("-"))) for n in names if folders.exists(self.spark, f"{self.path}/runs/run={n}/_SUCCESS"))
        return [r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found)]

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/runs/run={run[0]:012d}-{run[1]:012d}"

    def _rows(self, runs: Sequence[tuple[int, int]]) -> DataFrame:
        """All rows of some runs, with the number of the run's last batch."""
        read = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/runs").parquet(*map(self._folder, runs))
        return read.withColumn("_seq", F.substring_index(F.col("run").cast("string"), "-", -1).cast("long")).drop("run")

    def _largest(self, rows: DataFrame, *newest: str) -> DataFrame:
        total = sum((F.col(c) for c in _TOKENS[1:]), F.col(_TOKENS[0]))
        order = Window.partitionBy(self.key).orderBy(F.desc(total), *map(F.desc, newest), F.desc("timestamp"))
        return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")

    def read(self) -> DataFrame | None:
        """One row for each key, with the ``day`` that it lies on."""
        runs = self.runs()
        return self._dated(self._largest(self._rows(runs), "_seq").drop("_seq", "bucket")) if runs else None

    @staticmethod
    def _dated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("day", F.timestamp_millis("timestamp").cast("date").cast("string"))

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(KEY_BUCKETS)).cast("int"))
        dealt.repartition("bucket").sortWithinPartitions("bucket", self.key).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy("bucket").parquet(self._folder(run))

    def _applied(self, source: str) -> dict[int, int]:
        """The run of each batch of a source that is on record: of the last batches, as older ones never come again."""
        found = (n.split("-") for n in folders.children(self.spark, f"{self.path}/applied/{source}"))
        return {int(batch): int(run) for batch, run in found}

    def _days_of(self, keys: DataFrame) -> set[str]:
        """Days that any stored row of the keys lies on; only their buckets are read, and only keys and times."""
        runs = self.runs()
        if not runs:
            return set()
        buckets = [r.bucket for r in keys.select("bucket").distinct().collect()]
        stored = self._rows(runs).where(F.col("bucket").isin(buckets)).select(self.key, "timestamp")
        return {r.day for r in self._dated(stored.join(keys.select(self.key), self.key, "left_semi")).select("day").distinct().collect()}

    def upsert(self, batch: DataFrame, batch_id: int = 0, on_days: Callable[[list[str]], None] | None = None, source: str = "batches") -> None:
        """For ``foreachBatch``: appends a run; a batch that comes again takes its own run's place, or changes nothing if that is merged.

        Batches of a ``source`` are numbered upwards. ``on_days`` gets the days of the batch and of all rows that its keys
        had: what was derived from them is out of date. Columns that are new are added.
        """
        new = batch.persist()
        try:
            days = {r.day for r in self._dated(new).select("day").distinct().collect()}
            if not days:
                return
            keys = new.select(self.key, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(KEY_BUCKETS)).cast("int").alias("bucket")).distinct()
            days |= self._days_of(keys)
            applied, runs = self._applied(source), self.runs()
            if not applied or batch_id > max(applied):
                seq = max([r[1] for r in runs] + self._reserved(), default=0) + 1
                folders.make(self.spark, f"{self.path}/applied/{source}/{batch_id}-{seq}")
                for old, at in applied.items():
                    folders.remove(self.spark, f"{self.path}/applied/{source}/{old}-{at}")
                applied = {batch_id: seq}
            seq = applied.get(batch_id)
            if seq is not None and not any(a <= seq <= b and a < b for a, b in runs):
                self._write(self._largest(new), (seq, seq))
        finally:
            new.unpersist()
        if on_days:
            on_days(sorted(days))
        self.compact()

    def _reserved(self) -> list[int]:
        return [at for s in folders.children(self.spark, f"{self.path}/applied") for at in self._applied(s).values()]

    def compact(self) -> None:
        """Merges the runs at the end while there are ``fanout`` of one size, and removes what lies within a merged one."""
        while True:
            runs = self.runs()
            size = [self._level(b - a + 1) for a, b in runs]
            # of one size, and without a number between them that a batch has taken but not written yet
            same = 1
            while same < len(runs) and size[-same - 1] == size[-1] and runs[-same - 1][1] + 1 == runs[-same][0]:
                same += 1
            if len(runs) < self.fanout or same < self.fanout:
                break
            last = runs[-same:]
            whole = (last[0][0], last[-1][1])
            self._write(self._largest(self._rows(last), "_seq").drop("_seq", "bucket"), whole)
        live = {f"run={a:012d}-{b:012d}" for a, b in runs}
        for name in folders.children(self.spark, f"{self.path}/runs"):
            a, b = map(int, name.removeprefix("run=").split("-"))
            if name not in live and any(x <= a and b <= y for x, y in runs):
                folders.remove(self.spark, f"{self.path}/runs/{name}")

    def _level(self, batches: int) -> int:
        level = 0
        while batches >= self.fanout:
            batches //= self.fanout
            level += 1
        return level

    def start(self, stream: DataFrame, checkpoint: str, on_days: Callable[[list[str]], None] | None = None):
        """Everything that is there now, then stops; a restart goes on where the checkpoint ends."""
        source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        return stream.writeStream.foreachBatch(lambda b, i: self.upsert(b, i, on_days, source)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ChangeFeed:
    """Batches of changes under one folder, numbered without gaps, and snapshots of what they add up to.

    A batch is the partition of its number. Every ``snapshot_every`` batches a snapshot is made of the one before it and the
    batches since; batches more than ``keep`` before it, and older snapshots, go.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], snapshot_every: int = 100, keep: int = 20):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.snapshot_every, self.keep = snapshot_every, keep

    def _numbers(self, kind: str) -> list[int]:
        return folders.complete(self.spark, f"{self.path}/{kind}", "seq=")

    def snapshot(self) -> int:
        """Number of the latest snapshot, 0 without any."""
        return (self._numbers("snapshots") or [0])[-1]

    def publish(self, rows: DataFrame, seq: int) -> None:
        """A batch is written as a whole: publishing it again replaces it."""
        rows.write.mode("overwrite").json(f"{self.path}/batches/seq={seq:012d}")
        if self.cursor(self.snapshot()) - self.snapshot() >= self.snapshot_every:
            self._snap()

    def _snap(self) -> None:
        at = self.cursor(self.snapshot())
        self._rows(self.snapshot(), True).write.mode("overwrite").json(f"{self.path}/snapshots/seq={at:012d}")
        for kind, least in (("batches", max(at - self.keep, 0)), ("snapshots", at)):
            for n in self._numbers(kind):
                if n < least:
                    folders.remove(self.spark, f"{self.path}/{kind}/seq={n:012d}")

    def cursor(self, after: int = 0) -> int:
        """How far a reader that has applied ``after`` gets: past the latest snapshot, and on to the first batch that is missing."""
        at, have = max(after, self.snapshot()), set(self._numbers("batches"))
        while at + 1 in have:
            at += 1
        return at

    def _rows(self, after: int, whole: bool) -> DataFrame:
        """(columns, version): the latest row of each key of the batches behind ``after``, and, for ``whole``, of the snapshot."""
        snapshot = self.snapshot()
        rows = self.spark.createDataFrame([], f"{self.schema}, version long")
        if whole and snapshot:
            rows = self.spark.read.schema(f"{self.schema}, version long").json(f"{self.path}/snapshots/seq={snapshot:012d}")
        behind = range(max(after, snapshot) + 1, self.cursor(after) + 1)
        if behind:
            read = self.spark.read.option("basePath", f"{self.path}/batches").schema(f"{self.schema}, seq long")
            rows = rows.unionByName(read.json([f"{self.path}/batches/seq={n:012d}" for n in behind]).withColumnRenamed("seq", "version"))
        return latest_versions(rows, self.keys, "version")

    def apply(self, after: int = 0) -> DataFrame:
        """The latest row of each key from what a reader at ``after`` has not seen; one behind the snapshot gets all of it."""
        return self._rows(after, after < self.snapshot()).drop("version")
