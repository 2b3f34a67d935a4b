"""The reports that a front end asks for, over one store of usage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import calendar as cal
from meterlake.operators import activity, lookup, maintenance, metrics, pricing, statistics, survival
from meterlake.operators import sessions as S
from meterlake.operators.filters import UNKNOWN_SOURCE, in_range, price_matches, repriced, source_filter, tool_in, visible_in_store
from meterlake.operators.merge import merge_facts, message_sessions
from meterlake.plans.inputs import FiledInput
from meterlake.plans.materialize import DayStore, can_use_summaries, day_dependencies, fingerprints, observations, ranges_of

WINDOWS = ("5h", "24h", "7d", "30d", "today", "current_month")


@dataclass(frozen=True)
class Context:
    """What every report depends on besides the data. Nothing reads the clock."""

    as_of: int
    tz: str = "UTC"
    boundary: int = 0
    tool: str | None = None
    source: str | None = None
    sources: tuple[dict, ...] = field(default=())
    include_errors: bool = True

    def day_of(self, seconds: int) -> str:
        """Business date of a second."""
        return str((cal.datetime.fromtimestamp(seconds, cal.ZoneInfo(self.tz)).replace(tzinfo=None) - cal.timedelta(hours=self.boundary)).date())

    def today(self) -> str:
        return self.day_of(self.as_of)

    def since(self, window: str) -> int:
        return cal.window_start(window, self.as_of, self.tz, self.boundary)


class Report(dict):
    """Parts of a report by name, over one frame that is held until ``release``, or to the end of a ``with``."""

    def __init__(self, parts: dict[str, DataFrame], held: DataFrame):
        super().__init__(parts)
        self.held = held

    def release(self) -> None:
        self.held.unpersist()

    def __enter__(self) -> Report:
        return self

    def __exit__(self, *_) -> None:
        self.release()


@dataclass
class Usage:
    """Observations, dimensions and, where there is one, the store of finished days.

    With ``files`` (by side: proxy, local, remote) the store is refreshed from an index of files, and days are merged from the
    files that reach into them.
    """

    proxy: DataFrame
    local: DataFrame
    sessions: DataFrame
    prices: DataFrame
    remote: DataFrame | None = None
    store: DayStore | None = None
    files: dict[str, FiledInput] | None = None

    @classmethod
    def of_files(cls, files: dict[str, FiledInput], sessions: DataFrame, prices: DataFrame, store: DayStore) -> Usage:
        """Usage of what lies in files; reports come from the store."""
        for f in files.values():
            f.refresh()
        whole = {side: f.in_ranges([(0, None)]) for side, f in files.items()}
        return cls(whole["proxy"], whole["local"], sessions, prices, whole.get("remote"), store, files)

    def facts(self, c: Context, start: int | None = None, end: int | None = None) -> DataFrame:
        """Facts of a range that pass the context's filters. The range restricts the inputs of the merge, never its result."""

        def cut(rows: DataFrame | None, unit: int) -> DataFrame | None:
            return rows if rows is None or start is None else rows.where(in_range(F.col("timestamp"), start * unit, None if end is None else end * unit))

        proxy, local, remote = cut(self.proxy, 1000), cut(self.local, 1), cut(self.remote, 1)
        if self.store is not None:
            found = self.store.facts(self._hot(c), c.today(), None if start is None else c.day_of(start), self._day_after(c, end))
            found = found if start is None else found.where(in_range(F.col("timestamp_sec"), start, end))
        else:
            found = merge_facts(proxy, local, remote, self.sessions, self.prices, True)
        return self._chosen_facts(c, found)

    @staticmethod
    def _chosen_facts(c: Context, found: DataFrame) -> DataFrame:
        """Facts that pass the context's filters."""
        chosen = source_filter(F.col("api_key_prefix"), F.col("request_base_url"), list(c.sources), c.source)
        if not c.include_errors:
            found = found.where(visible_in_store(F.col("status_code")))
        return found.where(tool_in(F.col("tool"), c.tool) & chosen)

    @staticmethod
    def _day_after(c: Context, end: int | None) -> str | None:
        """The first business day of which nothing lies before ``end``."""
        return None if end is None else str(cal.date.fromisoformat(c.day_of(end - 1)) + cal.timedelta(days=1))

    def _hot(self, c: Context) -> DataFrame:
        """All facts since the business day began."""
        today = cal.date.fromisoformat(c.today())
        first = cal.business_day_bounds(today, c.tz, c.boundary)[0]
        # from a day before on, and from days that share requests with this one: observers may see a request on different days
        before = {str(today - cal.timedelta(days=1)), *self.store.linked(c.today())}
        *earlier, (start, end) = ranges_of(before | {str(today)}, c.tz, c.boundary)
        return self.merged([*earlier, (start, None)]).where(F.col("timestamp_sec") >= first)

    def merged(self, ranges: Sequence[tuple[int, int | None]]) -> DataFrame:
        """Facts merged from inputs of ranges of seconds: what a store builds days from."""

        def cut(side: str, rows: DataFrame | None, unit: int) -> DataFrame | None:
            if rows is None:
                return None
            if self.files is not None:
                rows = self.files[side].in_ranges(ranges)
            inside = F.lit(False)
            for start, end in ranges:
                inside = inside | in_range(F.col("timestamp"), start * unit, None if end is None else end * unit)
            return rows.where(inside)

        return merge_facts(cut("proxy", self.proxy, 1000), cut("local", self.local, 1), cut("remote", self.remote, 1), self.sessions, self.prices, True)

    def refresh_store(self, c: Context) -> list[str]:
        """Builds the finished days that are missing or out of date, and gives them."""
        if self.files is not None:
            return self._refresh_from_files(c)
        depends = day_dependencies(self.proxy, self.local, self.remote, c.tz, c.boundary, self.sessions, self.prices)
        seen = observations(self.proxy, self.local, self.remote, c.tz, c.boundary)
        return self.store.refresh(self.merged, depends, seen, c.today())

    def _refresh_from_files(self, c: Context) -> list[str]:
        for f in self.files.values():
            f.refresh()
        met = None
        for f in self.files.values():
            met = f.seen_sessions() if met is None else met.unionByName(f.seen_sessions())
        depends = fingerprints({side: f.days() for side, f in self.files.items()}, met.distinct(), self.sessions, self.prices)

        def seen(days: Sequence[str]) -> DataFrame:
            rows = {side: f.on_days(days) for side, f in self.files.items()}
            return observations(rows["proxy"], rows["local"], rows.get("remote"), c.tz, c.boundary)

        return self.store.refresh(self.merged, depends, seen, c.today())

    def _cells(self, c: Context, start: int, end: int, step: int) -> DataFrame:
        """The report's cells: from stored days where they answer it, else from facts."""
        whole = c.boundary == 0 and cal.business_day_bounds(cal.date.fromisoformat(c.day_of(start)), c.tz)[0] == start and (end > c.as_of or cal.business_day_bounds(cal.date.fromisoformat(c.day_of(end)), c.tz)[0] == end)
        if self.store is None or not whole or not can_use_summaries(step, c.tool, c.source):
            return statistics.cells(self.facts(c, start, end), step, c.tz)
        found = self.store.cells(self._hot(c), c.today(), c.day_of(start), self._day_after(c, end)).where(in_range(F.col("bucket_start"), start, end))
        return found if c.include_errors else found.where(visible_in_store(F.col("status_code")))

    def statistics_summary(self, c: Context, start: int, end: int, step: int = cal.HOUR, metric: str = "tokens") -> Report:
        """All parts of the report, from one small frame of cells that is held while they are shown; release it then."""
        f = self._cells(c, start, end, step).persist()
        parts = {
            "totals": statistics.totals(f),
            "trend": statistics.trend(f, start, end, step, c.tz),
            "models": statistics.model_table(f),
            "status_codes": metrics.status_histogram(f, "model"),
            "model_trends": statistics.model_trends(f, start, end, step, c.tz),
            "performance": statistics.performance(f),
            "status": metrics.status_block(f),
            "coverage": metrics.coverage(f),
            "insights": statistics.insights(f, step, metric, c.tz),
        }
        return Report(parts, f)

    def daily_models(self, c: Context) -> DataFrame | None:
        """Day and model metrics from the store, if the report may use them."""
        if self.store is None or not can_use_summaries(cal.DAY, c.tool, c.source):
            return None
        return self.store.model_days(self._hot(c), c.today())

    def _windows(self, c: Context, facts: DataFrame) -> DataFrame:
        """Facts or, where stored days answer the report, cells, with the window that they count in."""
        since = {w: c.since(w) for w in WINDOWS}
        if self.store is None or not can_use_summaries(cal.DAY, c.tool, c.source):
            return statistics.windowed(facts, since)
        found = self.store.window_cells(self._hot(c), since, c.as_of, c.today())
        return found if c.include_errors else found.where(visible_in_store(F.col("status_code")))

    def refresh_bundle(self, c: Context, window: str = "24h") -> dict[str, DataFrame]:
        f = self.facts(c, c.since("30d") if window != "current_month" else min(c.since("30d"), c.since(window)), c.as_of + 1)
        inside = f.where(F.col("timestamp_sec") >= c.since(window))
        windows = self._windows(c, f)
        return {"windows": statistics.usage_of_windows(windows, {w: c.since(w) for w in WINDOWS}), "window_models": statistics.window_models(windows), "distribution": statistics.distribution(inside), "status": metrics.status_block(inside), "coverage": metrics.coverage(inside, weighted=True), "survival": survival.survival(f, c.as_of)}

    def overview_breakdown(self, c: Context, window: str, sources: DataFrame, tools: DataFrame | None = None) -> dict[str, DataFrame]:
        f = self.facts(c, c.since(window), c.as_of + 1)
        by_tool = statistics.ranking(f, "tool")
        return {"source": statistics.ranking(statistics.with_source(f, sources), "source_key", "source_name"), "tool": by_tool if tools is None else statistics.with_tool_profile(by_tool, tools), "model": statistics.ranking(f, "model")}

    def window_rate_summary(self, c: Context, window: str) -> dict[str, DataFrame]:
        f = self.facts(c, c.since(window), c.as_of + 1)
        return {"overall": statistics.overall_rate(f), "by_model": statistics.rates_by_model(f), "ttft_by_model": statistics.first_tokens_by_model(f)}

    def deferred_bundle(self, c: Context, window: str, sources: DataFrame) -> dict[str, DataFrame]:
        return self.refresh_bundle(c, window) | self.overview_breakdown(c, window, sources) | self.window_rate_summary(c, window)

    def month_activity(self, c: Context, year: int, month: int, metric: str = "tokens") -> DataFrame:
        return activity.month_activity(activity.day_activity(self.facts(c), c.tz, c.boundary), year, month, metric)

    def year_activity(self, c: Context, year: int, metric: str = "tokens") -> DataFrame:
        return activity.year_activity(activity.day_activity(self.facts(c), c.tz, c.boundary), year, metric)

    def all_sessions(self, c: Context, limit: int = 50, offset: int = 0) -> DataFrame:
        bare = c.source in (None, UNKNOWN_SOURCE)
        return S.latest(S.all_sessions(self.facts(c), self.sessions.where(tool_in(F.col("tool"), c.tool)), bare), limit, offset)

    def session_detail(self, c: Context, session_id: str) -> DataFrame:
        """One session. Stored days know the sessions of their facts; without them only the session's keys are merged."""
        one = F.col("session_id") == session_id
        if self.store is not None:
            found = self.facts(c).where(one)
        else:
            found = self._chosen_facts(c, lookup.session_facts(session_id, self.proxy, self.local, self.remote, sessions=self.sessions.where(one), prices=self.prices, include_errors=True))
        return S.all_sessions(found, self.sessions.where(one))

    def project_stats(self, c: Context) -> DataFrame:
        return S.nested_projects(self.facts(c), self.sessions)

    def recent_requests(self, c: Context, limit: int = 30, offset: int = 0) -> DataFrame:
        """A page of at most 30 requests. Without stored days, the keys seen lately are merged, as far back as the page needs."""
        limit, offset = min(max(limit, 1), 30), min(max(offset, 0), 200)
        if self.store is not None:
            return lookup.newest(self.facts(c), limit, offset)
        found = lookup.newest_facts(limit + offset, lambda f: self._chosen_facts(c, f), self.proxy, self.local, self.remote, sessions=self.sessions, prices=self.prices, include_errors=True)
        return lookup.newest(found, limit, offset)

    def timeline(self, c: Context, start: int | None = None, end: int | None = None) -> DataFrame:
        """Facts of a range from the first to the last."""
        return self.facts(c, start, end).orderBy("timestamp_ms", "canonical_request_key")

    def session_of_message(self, message_id: str) -> DataFrame:
        """(message_id, session_id) of one message; no row if nobody knows it."""
        return message_sessions(self.local.where(F.col("message_id") == message_id))

    def drop_device(self, c: Context, device: str | None) -> list[str]:
        """Drops what has come from a device, or from all for None; gives the days that are to be built anew."""
        self.remote, days = maintenance.without_device(self.remote, device, cal.business_date(F.col("timestamp"), c.tz, c.boundary).cast("string"))
        touched = sorted(r.day for r in days.collect())
        if self.store is not None:
            self.store.invalidate(touched, c.today())
        return touched

    def maintenance_stats(self, files: DataFrame) -> DataFrame:
        total, orphans = self.local.agg(F.count("*").alias("total")), maintenance.orphan_facts(self.local, self.sessions, files).agg(F.count("*").alias("orphans"))
        return total.join(orphans)

    def purge_orphans(self, files: DataFrame, key: str, before: int) -> tuple[DataFrame, DataFrame]:
        return maintenance.purged(self.local, self.sessions, maintenance.orphan_facts(self.local, self.sessions, files), key, before)

    def search_prices(self, query: str, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """(page, number of all matches)"""
        hit = price_matches(F.col("model_id"), F.col("display_name"), query)
        return pricing.search(self.prices, hit, limit, offset), self.prices.where(hit).agg(F.count("*").alias("total"))

    def _chosen(self, models: list[str], **range_and_filters):
        return repriced(F.col("model"), F.expr("timestamp div 1000"), F.col("client_tool"), F.col("api_key_prefix"), F.col("cost_locked"), models, **range_and_filters)

    def preview_repricing(self, models: list[str], **kw) -> DataFrame:
        return pricing.preview_repricing(self.proxy, self._chosen(models, **kw))

    def apply_repricing(self, models: list[str], price: dict[str, float | None], **kw) -> DataFrame:
        return pricing.repriced_records(self.proxy, self._chosen(models, **kw), price)
