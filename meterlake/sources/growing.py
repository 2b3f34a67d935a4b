"""Tables of someone else's SQLite file as a stream, whose offsets are the last (time, row) that has been read."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

OPTIONS = ("path", "dbtable", "timeColumn", "rowColumn", "rowsPerTask")


class GrowingTable(DataSourceStreamReader):
    """Rows behind the last (time, row), up to the end that the table has when a batch is planned.

    Spark records both ends before it reads and gives the same ones again after a failure. What arrives during a read lies
    behind its end, and comes with the next. Rows without a time or a name come with the first batch, which takes all that
    there is once a row has both. An empty table gives no rows. If the newest rows go, the end goes back with them, and what then comes behind it is read. A row that comes
    late, with a time before the end, or is changed in its place, is not seen: ``KeysetCheckpoint`` reads all again for that.

    Options: path, dbtable, timeColumn and rowColumn (numbers or texts, together without repeats), rowsPerTask.
    """

    def __init__(self, schema, options: dict[str, str]):
        self.path, self.columns = options["path"], ", ".join(_quoted(f.name) for f in schema.fields)
        self.table, self.rows_per_task = _quoted(options["dbtable"]), int(options.get("rowsPerTask", "100000"))
        self.time, self.row = _quoted(options.get("timeColumn", "time_updated")), _quoted(options.get("rowColumn", "id"))

    def _query(self, sql: str, values: tuple = ()) -> Iterator[tuple]:
        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            yield from db.execute(sql, values)

    def initialOffset(self) -> dict:
        return {"time": None, "row": None}

    def latestOffset(self) -> dict:
        key = f"{self.time}, {self.row}"
        last = next(self._query(f"SELECT {key} FROM {self.table} WHERE {self.time} IS NOT NULL AND {self.row} IS NOT NULL ORDER BY {self.time} DESC, {self.row} DESC LIMIT 1"), None)
        return dict(zip(("time", "row"), last, strict=True)) if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Ranges of about ``rowsPerTask`` rows, however many share a time."""
        where, values = self._between(_key(start), _key(end))
        numbered = f"SELECT {self.time} AS t, {self.row} AS r, row_number() OVER (ORDER BY {self.time}, {self.row}) AS n FROM {self.table} WHERE ({where}) AND {self.time} IS NOT NULL AND {self.row} IS NOT NULL"
        cuts = list(self._query(f"SELECT t, r FROM ({numbered}) WHERE n % ? = 0 ORDER BY t, r", (*values, self.rows_per_task)))
        ends = [_key(start), *(c for c in cuts if c != _key(end)), _key(end)]
        return [InputPartition(pair) for pair in zip(ends, ends[1:], strict=False)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where, values = self._between(*partition.value)
        return self._query(f"SELECT {self.columns} FROM {self.table} WHERE {where}", values)

    def _between(self, lower: tuple | None, upper: tuple | None) -> tuple[str, tuple]:
        """The condition of rows behind ``lower`` up to ``upper``, and its values; without ``lower``, rows without a key too."""
        key, known = f"({self.time}, {self.row})", f"({self.time} IS NOT NULL AND {self.row} IS NOT NULL)"
        if upper is None:
            return "0", ()
        if lower is None:
            return f"NOT {known} OR {key} <= (?, ?)", upper
        return f"{known} AND {key} > (?, ?) AND {key} <= (?, ?)", (*lower, *upper)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _key(offset: dict) -> tuple | None:
    return None if offset["time"] is None else (offset["time"], offset["row"])
