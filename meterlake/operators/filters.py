"""Predicates on requests, facts and prices."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.keys import is_blank

#: A family's head stands for all its members (fixed values).
TOOL_FAMILIES = {"qoder_ide": ("qoder_ide", "qoder_ide_cn", "qoder_cli", "qoder_work", "qoder_work_cn")}
UNKNOWN_SOURCE = "__unknown__"


def in_range(ts: Column, start: int, end: int | None = None) -> Column:
    """start <= ts < end; a start below 0 is 0, and the end lies behind the start."""
    start = max(0, start)
    return (ts >= start) if end is None else (ts >= start) & (ts < max(end, start + 1))


def tool_in(tool: Column, wanted: str | Sequence[str] | None) -> Column:
    """All for None and blank, a family for its head, a tool, or any of some; none of an empty list."""
    if wanted is None or (isinstance(wanted, str) and not wanted.strip()):
        return F.lit(True)
    names = TOOL_FAMILIES.get(wanted, (wanted,)) if isinstance(wanted, str) else tuple(wanted)
    return tool.isin(*names) if names else F.lit(False)


def from_source(prefix: Column, url: Column, prefixes: Sequence[str], base_url: str | None) -> Column:
    """The prefix is one of the source's and the url is its url, null and blank alike."""
    same = F.coalesce(url, F.lit("")) == (base_url or "")
    return F.coalesce(prefix.isin(*prefixes), F.lit(False)) & same if prefixes else F.lit(False)


def from_unknown_source(prefix: Column, url: Column, known: Iterable[tuple[str, str | None]]) -> Column:
    """No (prefix, url) pair that is known; a null prefix is unknown, and without known pairs all are."""
    out = F.lit(False)
    for p, u in known:
        out = out | ((F.coalesce(prefix, F.lit("")) == p) & url.eqNullSafe(F.lit(u)))
    return prefix.isNull() | ~out


def source_filter(prefix: Column, url: Column, sources: Sequence[dict], wanted: str | None) -> Column:
    """By a configured source's id: ``__unknown__`` for those of none, everything for None or an id that isn't configured."""
    if wanted == UNKNOWN_SOURCE:
        return from_unknown_source(prefix, url, [(p, s.get("base_url")) for s in sources for p in s["api_key_prefixes"]])
    source = next((s for s in sources if s["id"] == wanted), None)
    return F.lit(True) if source is None else from_source(prefix, url, source["api_key_prefixes"], source.get("base_url"))


def visible_at_merge(status: Column, include_errors: bool = False) -> Column:
    return F.lit(True) if include_errors else status.between(200, 299)


def visible_in_store(status: Column) -> Column:
    """Local requests, which have no status, are visible."""
    return status.isNull() | (status < 300)


def after_key(t: Column, row: Column, last_t: int, last_row: int) -> Column:
    """What an incremental read has not seen yet."""
    return (t > last_t) | ((t == last_t) & (row > last_row))


def price_matches(model_id: Column, display_name: Column, query: str) -> Column:
    q = query.strip().lower()
    return F.lower(model_id).contains(q) | F.lower(F.coalesce(display_name, F.lit(""))).contains(q)


def repriced(model: Column, seconds: Column, tool: Column, prefix: Column, locked: Column, models: Sequence[str], start: int | None = None, end: int | None = None, tools: Sequence[str] = (), prefixes: Sequence[str] = ()) -> Column:
    """Unlocked records of the models; the time range includes both ends."""
    out = ~F.coalesce(locked, F.lit(False)) & model.isin(*models)
    if start is not None:
        out = out & (seconds >= start)
    if end is not None:
        out = out & (seconds <= end)
    if tools:
        out = out & tool.isin(*tools)
    return out & prefix.isin(*prefixes) if prefixes else out


def counts_tokens(*tokens: Column) -> Column:
    """Rows that used anything."""
    total = F.lit(0)
    for t in tokens:
        total = total + F.coalesce(t, F.lit(0))
    return total > 0


#: How texts begin that a tool writes in the user's name (fixed values).
SYSTEM_PREFIXES = ("# AGENTS.md", "<environment_context>")


def is_system_text(text: Column) -> Column:
    """Text that a tool wrote in the user's name, or none at all."""
    out = is_blank(text)
    for p in SYSTEM_PREFIXES:
        out = out | F.regexp_replace(text, r"^\s+", "").startswith(p)
    return out


def without_orphans(rows: DataFrame, owners: DataFrame, on: str) -> DataFrame:
    return rows.join(owners.select(on).distinct(), on, "left_semi")
