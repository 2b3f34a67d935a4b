"""Price catalogues, exchange rates, foreign databases and the registry of readers."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from meterlake.operators.maintenance import changed_keys
from meterlake.operators.pricing import newest_prices
from meterlake.sources import files, transcripts
from meterlake.sources.growing import OPTIONS, GrowingTable

_MODEL = "struct<id:string,name:string,cost:struct<input:double,output:double,cache_read:double,cache_write:double>,last_updated:string>"


def price_catalogue(bodies: DataFrame, body: str = "body") -> DataFrame:
    """PRICES from JSON of providers and their models: of each model id the offer updated last, if it has a price."""
    providers = bodies.select(F.explode(F.from_json(body, f"map<string,struct<models:map<string,{_MODEL}>>>")).alias("provider", "p"))
    offers = providers.select("provider", F.explode("p.models").alias("key", "m")).select(
        F.coalesce("m.id", "key").alias("model_id"),
        F.col("m.name").alias("display_name"),
        F.col("m.cost.input").alias("input_price"),
        F.col("m.cost.output").alias("output_price"),
        F.col("m.cost.cache_read").alias("cache_read_price"),
        F.col("m.cost.cache_write").alias("cache_write_price"),
        F.lit("api").alias("source"),
        F.unix_timestamp(F.try_to_timestamp("m.last_updated")).alias("last_updated"),
        "provider",
    )
    return newest_prices(offers).drop("provider")


def exchange_rates(bodies: DataFrame, wanted: Sequence[str], body: str = "body") -> DataFrame:
    """(currency, rate) of those that are wanted; the dollar is 1."""
    rates = bodies.select(F.explode(F.from_json(F.get_json_object(body, "$.rates"), "map<string,double>")).alias("currency", "rate"))
    return rates.where(F.col("currency").isin([c for c in wanted if c != "USD"])).unionByName(bodies.sparkSession.createDataFrame([("USD", 1.0)], "currency string, rate double"))


class _Rows(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        """Runs of row ids; a table is read in as many tasks as are asked for."""
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM \"{self.options['dbtable']}\"").fetchone()
        if low is None:
            return []
        n = max(1, int(self.options.get("numPartitions", "1")))
        step = -(-(high - low + 1) // n)
        return [InputPartition((i, min(i + step, high + 1))) for i in range(low, high + 1, step)]

    def read(self, partition: InputPartition):
        columns = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {columns} FROM \"{self.options['dbtable']}\" WHERE rowid >= ? AND rowid < ?", partition.value)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")`` or ``spark.readStream`` with path, dbtable and a schema: tables of tools that keep a SQLite file on a shared path."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> DataSourceReader:
        return _Rows(schema, dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingTable(schema, {given: self.options[given] for given in OPTIONS if given in self.options})


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).option("path", path).option("dbtable", table).option("numPartitions", partitions).load()


def stream_sqlite(spark: SparkSession, path: str, table: str, schema: str, time: str = "time_updated", row: str = "id", rows_per_task: int = 100_000) -> DataFrame:
    """The rows of a table that grows, as a stream: each batch has what has come since the one before."""
    spark.dataSource.register(SqliteSource)
    return spark.readStream.format("sqlite").schema(schema).options(path=path, dbtable=table, timeColumn=time, rowColumn=row, rowsPerTask=rows_per_task).load()


def schema_mode(columns: Sequence[str]) -> str:
    """What a foreign message table can give: full, message_only or incompatible."""
    have = set(columns)
    if {"id", "session_id", "time_created", "time_updated", "data"} <= have:
        return "full"
    return "message_only" if {"id", "session_id", "data"} <= have else "incompatible"


#: Readers of file-backed tools: (spark, path) -> LOCAL requests
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "claude_code": transcripts.assistant_lines,
    "codex": transcripts.rollout_lines,
    "gemini": transcripts.chat_documents,
    "copilot_cli": transcripts.shutdown_totals,
    "openclaw": transcripts.agent_lines,
    "qoder_cli": lambda spark, path: transcripts.assistant_lines(spark, path, "qoder_cli"),
    "qoder_work": transcripts.log_lines,
    "opencode": transcripts.message_documents,
}


#: Foreign tables as LOCAL requests
TABLES: dict[str, Callable[..., DataFrame]] = {"opencode": transcripts.database_messages, "hermes": transcripts.session_totals, "qoder_ide": transcripts.editor_messages}


def changed_files(spark: SparkSession, path: str, cached: DataFrame, glob: str = "*.jsonl") -> tuple[list[str], list[str], DataFrame]:
    """(paths that are new or differ, paths that are gone, fingerprints now). ``cached``: fingerprints of the last scan.

    Only file sizes and times are looked at. The lists are as long as what has changed.
    """
    now = files.listed(spark, path, glob)
    change = changed_keys(cached, now, "path", "fingerprint").collect()
    return sorted(r.path for r in change if r.change != "removed"), sorted(r.path for r in change if r.change == "removed"), now


def read_changed(spark: SparkSession, tool: str, path: str, cached: DataFrame, glob: str = "*.jsonl") -> tuple[DataFrame | None, list[str], DataFrame]:
    """(LOCAL requests of the changed files alone, paths that are gone, fingerprints now); no requests if nothing has changed."""
    dirty, gone, now = changed_files(spark, path, cached, glob)
    return (READERS[tool](spark, dirty) if dirty else None), gone, now


def read_tools(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """LOCAL requests of several tools, each from its root."""
    frames = [READERS[tool](spark, path) for tool, path in roots.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
