"""Finished days stored once, rebuilt when what they depend on changes, with the live day laid over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.calendar import DAY, business_date, business_day_bounds
from meterlake.functions.keys import is_blank
from meterlake.operators.merge import keyed_local, keyed_proxy
from meterlake.operators.metrics import added_up, daily_summary, measures, stated_tokens
from meterlake.operators.statistics import cells
from meterlake.plans import folders
from meterlake.plans.migrations import Migrations, migrated, shape_number

FACTS, DAYS, CELLS, SEEN, LINKS, STATE = "facts", "daily", "cells", "seen", "links", "state"
#: Changes when partitions of another kind are needed: days that an older store holds are built anew.
_LAYOUT = 3
_PIECE = (1 << 22) - 1
_SEEN, _LINKS = "local_date string, h long, part string", "local_date string, other string, part string"
_STATE = "local_date string, fingerprint string, version long, mode string, shape int"


def content(rows: DataFrame) -> Column:
    """A sum over rows, in whatever order, that changes with any of their values.

    The hashes are summed in three pieces of 22 bits or fewer, as whole numbers are added up much faster than decimals.
    """
    h = F.xxhash64(*sorted(rows.columns))
    low, middle, high = F.sum(h.bitwiseAND(_PIECE)), F.sum(F.shiftright(h, 22).bitwiseAND(_PIECE)), F.sum(F.shiftright(h, 44))
    high, middle = (s.cast("decimal(20,0)") * F.lit(n).cast("decimal(14,0)") for s, n in ((high, 1 << 44), (middle, 1 << 22)))
    return (high + middle + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def fingerprints(sums: dict[str, DataFrame], seen: DataFrame, sessions: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """(local_date, fingerprint) of the sums of each side by day (local_date, n, s), of the sessions seen on a day, and of all prices.

    ``seen`` are distinct (local_date, session_id).
    """
    parts = None
    for side, days in sums.items():
        own = days.select("local_date", F.lit(side).alias("side"), "n", "s")
        parts = own if parts is None else parts.unionByName(own)
    if sessions is not None:
        meta = sessions.groupBy("session_id").agg(content(sessions).alias("_s"))
        met = seen.join(meta, "session_id")
        parts = parts.unionByName(met.groupBy("local_date").agg(F.count("*").alias("n"), F.sum("_s").cast("decimal(38,0)").alias("s")).select("local_date", F.lit("sessions").alias("side"), "n", "s"))
    days = parts.groupBy("local_date").agg(F.to_json(F.array_sort(F.collect_list(F.struct("side", "n", "s")))).alias("_own"))
    if prices is None:
        return days.select("local_date", F.sha2("_own", 256).alias("fingerprint"))
    at = prices.agg(F.count("*").alias("_n"), content(prices).alias("_p"))
    return days.join(F.broadcast(at), F.lit(True)).select("local_date", F.sha2(F.concat_ws("|", "_own", "_n", F.col("_p").cast("string")), 256).alias("fingerprint"))


def day_dependencies(proxy: DataFrame, local: DataFrame, remote: DataFrame | None = None, tz: str = "UTC", boundary: int = 0, sessions: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """(local_date, fingerprint): number and content of each input by day, of the sessions seen on it, and of all prices.

    Equal fingerprints: nothing to do. Any value that changes in an input row, in a session of the day or in a price makes
    another fingerprint. All rows are read; ``FiledInput`` gives the same of files without reading those that it knows.
    """
    sides = {"proxy": (proxy, F.expr("timestamp div 1000")), "local": (local, F.col("timestamp"))} | ({} if remote is None else {"remote": (remote, F.col("timestamp"))})
    sums, seen = {}, None
    for side, (rows, seconds) in sides.items():
        day, named = business_date(seconds, tz, boundary).alias("_day"), F.col("_day").cast("string").alias("local_date")
        sums[side] = rows.groupBy(day).agg(F.count("*").alias("n"), content(rows).alias("s")).select(named, "n", "s")
        own = rows.select(day, "session_id")
        seen = own if seen is None else seen.unionByName(own)
    return fingerprints(sums, seen.distinct().select(named, "session_id"), sessions, prices)


def observations(proxy: DataFrame, local: DataFrame, remote: DataFrame | None = None, tz: str = "UTC", boundary: int = 0) -> DataFrame:
    """Distinct (local_date, h): the hashed request keys and message ids that any side has on a day.

    Requests with a key in common become one fact, and a message lends its session to records that lack one: days that
    share a hash depend on each other. Hashes that collide only link days that need not be.

    Most keys are ``tool:message``: whoever shares such a key shares the message, so that the message's hash is enough, if neither
    part has a colon. Keys of other rows are hashed too, and what stands behind their only colon (if they have just one): those may be
    equal to a key of the first kind, whose message that is then.
    """
    sides = [(keyed_proxy(proxy), F.expr("timestamp div 1000")), (keyed_local(local), F.col("timestamp"))] + ([] if remote is None else [(keyed_local(remote), F.col("timestamp"))])
    out = None
    for rows, seconds in sides:
        k, message, tool = F.col("k"), F.col("message_id"), F.col("client_tool" if "client_tool" in rows.columns else "tool")
        explicit = F.col("canonical_request_key" if "canonical_request_key" in rows.columns else "request_key")
        has = ~is_blank(message)
        plain = is_blank(explicit) & has & tool.isNotNull() & ~F.coalesce(tool, F.lit("")).contains(":") & ~F.coalesce(message, F.lit("")).contains(":")
        of_message = F.xxhash64(F.lit("message"), message)
        rest = F.when(F.length(k) - F.length(F.replace(k, F.lit(":"), F.lit(""))) == 1, F.xxhash64(F.lit("message"), F.substring_index(k, ":", -1)))
        others = F.array_compact(F.array(F.xxhash64(F.lit("key"), k), F.when(has, of_message), rest))
        day = business_date(seconds, tz, boundary).alias("_day")
        own = rows.select(day, F.explode(F.when(plain, F.array(of_message)).otherwise(others)).alias("h"))
        out = own if out is None else out.unionByName(own)
    return out.distinct().select(F.col("_day").cast("string").alias("local_date"), "h")


def ranges_of(days: Sequence[str], tz: str = "UTC", boundary: int = 0) -> list[tuple[int, int]]:
    """Seconds from the beginning of a day to the end of the last day that follows on it, for each run of days."""
    out: list[tuple[int, int]] = []
    for d in sorted(days):
        start, end = business_day_bounds(date.fromisoformat(d), tz, boundary)
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


class DayStore:
    """Finished days under one folder: facts, daily summaries, and cells (metrics by day, model, status and coverage).

    Observers may see one request on different days. So the hashes of what was seen are kept by day, also for the live
    day: a change on one day reaches all days that share a key or message with it, as it was or as it is. What a day
    shares with which others is kept as its links.

    A day's rows lie in a partition named by the day and a version. The state, one row a day, says which version counts. It
    is written last, whole, under the next number, so that readers see a refresh entirely or not at all; what an
    interrupted one leaves behind is not named by any state and goes with the next ``vacuum``.

    The state also says in which shape a day was written. Days of older shapes are read through the ``migrations`` of their table, and
    written in today's shape whenever they are built again.
    """

    def __init__(self, spark: SparkSession, path: str, tz: str = "UTC", boundary: int = 0, migrations: Migrations | None = None):
        self.spark, self.path, self.tz, self.boundary = spark, path.rstrip("/"), tz, boundary
        self.migrations = migrations or {}
        self.shape = shape_number(self.migrations)
        self.mode = f"{tz}/{boundary}/{_LAYOUT}"

    def _versions(self) -> list[int]:
        return folders.complete(self.spark, f"{self.path}/{STATE}", "v=")

    def state(self) -> DataFrame:
        """(local_date, fingerprint, version, mode, shape); days that were built in another time zone or with another boundary don't count."""
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/{STATE}/v={found[-1]:012d}").where(F.col("mode") == self.mode)

    def _put(self, state: DataFrame) -> None:
        n = (self._versions() or [0])[-1] + 1
        if "shape" not in state.columns:
            state = state.withColumn("shape", F.lit(None).cast("int"))  # days as an older version knows them
        state.select(*(c.split()[0] for c in _STATE.split(", "))).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{STATE}/v={n:012d}")
        for old in self._versions()[:-2]:
            folders.remove(self.spark, f"{self.path}/{STATE}/v={old:012d}")

    def read(self, table: str, first: str | None = None, before: str | None = None) -> DataFrame | None:
        """Rows of the stored days from ``first`` to ``before``, exclusive; only those partitions are read. None if nothing is stored."""
        there = {n for n in folders.children(self.spark, f"{self.path}/{table}") if n.startswith("part=")}
        if not there:
            return None
        days = [r for r in self.state().collect() if f"part={r.local_date}.{r.version}" in there]
        chosen = [r for r in days if (first is None or r.local_date >= first) and (before is None or r.local_date < before)]
        if not chosen:
            # no rows, but a shape
            number, names = (days[-1].shape or 0, [f"part={days[-1].local_date}.{days[-1].version}"]) if days else (self.shape, [max(there)])
            return self._of_shape(table, number, names).where(F.lit(False))
        by_shape: dict[int, list[str]] = {}
        for r in chosen:
            by_shape.setdefault(r.shape or 0, []).append(f"part={r.local_date}.{r.version}")
        *older, newest = (self._of_shape(table, number, names) for number, names in sorted(by_shape.items()))
        for rows in older:
            newest = newest.unionByName(rows)
        return newest

    def _of_shape(self, table: str, number: int, names: Sequence[str]) -> DataFrame:
        """Partitions that were written in one shape, in today's."""
        rows = self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/{n}" for n in names)).drop("part")
        return migrated(rows, self.migrations.get(table, ()), number)

    def stale(self, dependencies: DataFrame, today: str) -> DataFrame:
        """Finished days whose stored fingerprint is missing or different."""
        return dependencies.where(F.col("local_date") < today).join(self.state().select("local_date", "fingerprint"), ["local_date", "fingerprint"], "left_anti")

    def refresh(self, build: Callable[[Sequence[tuple[int, int]]], DataFrame], dependencies: DataFrame, seen: DataFrame | Callable[[Sequence[str]], DataFrame], today: str) -> list[str]:
        """Rebuilds the stale days and those that share a request with them, forgets those without any input, and gives all of them.

        ``build(ranges)`` gives unfiltered facts, so that one store serves every filter, merged from the inputs of all the
        ranges of seconds. ``seen`` are the ``observations``, distinct, or gives those of some days. Only days that have changed are read for
        them; of other days the stored hashes are compared.
        """
        known = {r.local_date: r for r in self.state().collect()}
        # a live day has no facts here; its mark keeps it from passing for built once it is over
        current = {r.local_date: r.fingerprint if r.local_date < today else f"live:{r.fingerprint}" for r in dependencies.collect() if r.local_date is not None}
        due = {d for d, f in current.items() if d not in known or known[d].fingerprint != f}
        gone = {d for d in known if d not in current}
        if not due and not gone:
            return []
        version = (self._versions() or [0])[-1] + 1
        stored = self._seen(known.values())
        fresh = (seen(sorted(due)) if callable(seen) else seen).where(F.col("local_date").isin(sorted(due)))
        others = stored.where(~F.col("local_date").isin(sorted(due | gone)))
        reached = set()
        if any(d not in due and d not in gone for d in known):
            moved = fresh.select("h").unionByName(stored.where(F.col("local_date").isin(sorted(due | gone))).select("h")).distinct()
            reached = {r.local_date for r in others.join(moved, "h", "left_semi").select("local_date").distinct().collect()}
        again = sorted(due | reached)
        part = F.concat_ws(".", "local_date", F.lit(version))
        if again:
            self._write(fresh.unionByName(others.where(F.col("local_date").isin(sorted(reached)))).withColumn("part", part), SEEN)
            now = self.spark.read.schema(_SEEN).parquet(f"{self.path}/{SEEN}").where(F.col("part").isin([f"{d}.{version}" for d in again])).select("local_date", "h")
            every = now.unionByName(others.where(~F.col("local_date").isin(again))).select(F.col("local_date").alias("other"), "h")
            links = now.join(every, "h").where("local_date <> other").select("local_date", "other").distinct()
            self._write(links.withColumn("part", part), LINKS)
            linked = {r.other for r in self.spark.read.schema(_LINKS).parquet(f"{self.path}/{LINKS}").where(F.col("part").isin([f"{d}.{version}" for d in again if d < today])).select("other").distinct().collect()}
        whole = [d for d in again if d < today]
        if whole:
            dated = self.dated(build(ranges_of({*whole, *linked}, self.tz, self.boundary))).where(F.col("local_date").isin(whole)).withColumn("part", part)
            self._write(dated, FACTS)
            made = self.spark.read.schema(dated.schema).parquet(f"{self.path}/{FACTS}").where(F.col("part").isin([f"{d}.{version}" for d in whole]))
            found = cells(made, DAY, self.tz, "local_date", more=[stated_tokens()]).persist()
            self._write(daily_summary(found).withColumn("part", part), DAYS)
            self._write(found.drop("stated_tokens").withColumn("part", part), CELLS)
            found.unpersist()
        kept = [(d, r.fingerprint, r.version, self.mode, r.shape) for d, r in known.items() if d not in again and d not in gone]
        self._put(self.spark.createDataFrame(kept + [(d, current[d], version, self.mode, self.shape) for d in again], _STATE))
        return whole + sorted(d for d in gone if d < today)

    def _seen(self, states: Sequence) -> DataFrame:
        """(local_date, h) of the days of some states."""
        if not folders.exists(self.spark, f"{self.path}/{SEEN}"):
            return self.spark.createDataFrame([], "local_date string, h long")
        parts = [f"{r.local_date}.{r.version}" for r in states]
        return self.spark.read.schema(_SEEN).parquet(f"{self.path}/{SEEN}").where(F.col("part").isin(parts) if parts else F.lit(False)).select("local_date", "h")

    def linked(self, today: str) -> list[str]:
        """The finished days that share requests with the live one, as of the last refresh."""
        links = self.read(LINKS, today)
        return [] if links is None else sorted(r.other for r in links.where(F.col("other") < today).select("other").distinct().collect())

    def _write(self, rows: DataFrame, table: str) -> None:
        # rows of a day are brought together, so that a day has files for its size and not one from every task
        rows.hint("rebalance", F.col("part")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{table}")

    def dated(self, facts: DataFrame) -> DataFrame:
        return facts.withColumn("local_date", business_date(F.col("timestamp_sec"), self.tz, self.boundary).cast("string"))

    def cells_of(self, dated: DataFrame) -> DataFrame:
        return cells(dated, DAY, self.tz, "local_date")

    def invalidate(self, days: Sequence[str], today: str) -> None:
        """Forgets the fingerprints of days (never of today): the next refresh builds them anew; until then they are read as they are."""
        gone = [d for d in days if d != today]
        if gone and self._versions():
            self._put(self.state().withColumn("fingerprint", F.when(F.col("local_date").isin(gone), "").otherwise(F.col("fingerprint"))))

    def clear(self) -> None:
        """Forgets all days."""
        self._put(self.spark.createDataFrame([], _STATE))

    def rebuild(self, build: Callable[[Sequence[tuple[int, int]]], DataFrame], dependencies: DataFrame, seen: DataFrame | Callable[[Sequence[str]], DataFrame], today: str) -> list[str]:
        """All days anew, whatever is stored."""
        self.clear()
        done = self.refresh(build, dependencies, seen, today)
        self.vacuum()
        return done

    def vacuum(self) -> None:
        """Removes what no state names any more. Nobody may be reading or refreshing."""
        live = {f"part={r.local_date}.{r.version}" for r in self.state().collect()}
        for table in (FACTS, DAYS, CELLS, SEEN, LINKS):
            for name in folders.children(self.spark, f"{self.path}/{table}"):
                if name.startswith("part=") and name not in live:
                    folders.remove(self.spark, f"{self.path}/{table}/{name}")

    def _with_live(self, table: str, live: DataFrame, today: str, first: str | None, before: str | None = None) -> DataFrame:
        if before is not None and before <= today:
            # nothing of the live day is asked for: nothing is merged
            cold = self.read(table, first, before)
            return live.where(F.lit(False)) if cold is None else cold.select(live.columns)
        live = live.where(F.col("local_date") >= today)
        cold = self.read(table, first, today)
        return live if cold is None else cold.select(live.columns).unionByName(live)

    def facts(self, hot: DataFrame, today: str, first: str | None = None, before: str | None = None) -> DataFrame:
        """Stored days from ``first`` on and the live one, up to ``before``, exclusive."""
        return self._with_live(FACTS, self.dated(hot), today, first, before)

    def cells(self, hot: DataFrame, today: str, first: str | None = None, before: str | None = None) -> DataFrame:
        """Cells of stored days from ``first`` on, and of the live one, up to ``before``, exclusive."""
        return self._with_live(CELLS, self.cells_of(self.dated(hot)), today, first, before)

    def model_days(self, hot: DataFrame, today: str) -> DataFrame:
        """Metrics by day and model, with a map of requests by status: stored ones, and those of the live day."""
        return model_days(self.cells(hot, today))

    def window_cells(self, hot: DataFrame, windows: dict[str, int], as_of: int, today: str) -> DataFrame:
        """Cells with the ``window`` that they count in, for windows that begin at a second and end at ``as_of``.

        Whole days come from the stored cells; of a window's first day, if it begins within it, and of the live one, facts
        are measured.
        """
        bounds = {w: self._first_whole_day(s) for w, s in windows.items()}
        days = F.array(*(F.struct(F.lit(w).alias("window"), F.lit(d).alias("first")) for w, (d, _) in bounds.items()))
        live = self.dated(hot).where((F.col("local_date") >= today) & (F.col("timestamp_sec") <= as_of))
        edge = self.read(FACTS, min((e for _, e in bounds.values() if e), default="9999"), today)
        parts = [] if edge is None else [edge.where((F.col("local_date") == e) & (F.col("timestamp_sec") >= windows[w])).withColumn("window", F.lit(w)) for w, (_, e) in bounds.items() if e and e < today]
        inside = F.array(*(F.struct(F.lit(w).alias("window"), F.lit(s).cast("long").alias("since")) for w, s in windows.items()))
        some = live.withColumn("window", F.explode(F.transform(F.filter(inside, lambda x: x["since"] <= F.col("timestamp_sec")), lambda x: x["window"])))
        for p in parts:
            some = some.unionByName(p.select(some.columns))
        measured = cells(some, DAY, self.tz, "window")
        cold = self.read(CELLS, min(d for d, _ in bounds.values()), today)
        if cold is None:
            return measured
        whole = cold.withColumn("window", F.explode(F.transform(F.filter(days, lambda x: x["first"] <= F.col("local_date")), lambda x: x["window"])))
        return whole.select(measured.columns).unionByName(measured)

    def _first_whole_day(self, since: int) -> tuple[str, str | None]:
        """The first business day that begins at or behind a second, and the day before it if the second lies within that."""
        from datetime import datetime
        from zoneinfo import ZoneInfo

        day = (datetime.fromtimestamp(since, ZoneInfo(self.tz)).replace(tzinfo=None) - timedelta(hours=self.boundary)).date()
        begins = business_day_bounds(day, self.tz, self.boundary)[0]
        return (str(day), None) if begins >= since else (str(day + timedelta(days=1)), str(day))


def model_days(day_cells: DataFrame) -> DataFrame:
    """Cells gathered by day and model; a day and model has few statuses, which lie in a map."""
    by_status = measures(day_cells, "local_date", "model", "status_code")
    counts = F.map_from_entries(F.collect_list(F.when(F.col("status_code").isNotNull(), F.struct("status_code", "requests"))))
    return by_status.groupBy("local_date", "model").agg(*added_up(), counts.alias("status_counts"))


def can_use_summaries(step: int, tool: str | None, source: str | None) -> bool:
    """Daily summaries answer whole-day buckets without filters; all else needs facts."""
    return step == DAY and not (tool or "").strip() and not source
