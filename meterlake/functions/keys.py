"""Identity of requests, sources and projects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """True for null and for white space alone."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def unless_blank(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def request_key(explicit: Column, tool: Column, message_id: Column, session_id: Column, seconds: Column, model: Column, *tokens: Column) -> Column:
    """The explicit key, else tool and message, else everything that is known of the request."""
    parts = [tool, F.coalesce(session_id, F.lit("")), seconds.cast("string"), model, *(t.cast("string") for t in tokens)]
    return (
        F.when(~is_blank(explicit), F.trim(explicit))
        .when(~is_blank(message_id), F.concat_ws(":", tool, message_id))
        .otherwise(F.concat_ws(":", *(F.coalesce(p, F.lit("")) for p in parts)))
    )


def storage_key(tool: Column, message_id: Column, session_id: Column, start_ms: Column, timestamp_ms: Column, model: Column, *tokens: Column, stamped_tool: str = "opencode") -> Column:
    """Key under which a proxy record is stored; one tool reuses message ids, so that its start time is part of the key."""
    plain = request_key(F.lit(None).cast("string"), tool, message_id, session_id, timestamp_ms, model, *tokens)
    return F.when((tool == stamped_tool) & (F.coalesce(start_ms, F.lit(0)) > 0), F.concat_ws(":", plain, start_ms.cast("string"))).otherwise(plain)


def source_label(prefix: Column, url: Column) -> Column:
    """Key prefix, else base url, else null; blanks are absent."""
    return F.coalesce(F.trim(unless_blank(prefix)), F.trim(unless_blank(url)))


def source_id(prefix: Column, url: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``prefix|url``."""
    return F.substring(F.sha2(F.concat(F.coalesce(prefix, F.lit("")), F.lit("|"), F.coalesce(url, F.lit(""))), 256), 1, 16)


def normalized_base_url(url: Column, official_host: str = "api.anthropic.com") -> Column:
    """Null for the official service."""
    return F.when(~F.lower(url).contains(official_host), url)


def key_prefix(api_key: Column, length: int = 12) -> Column:
    return F.substring(api_key, 1, length)


def host_label(url: Column, official: str = "__official_api__") -> Column:
    """What stands between ``://`` and the next ``/``."""
    rest = F.when(url.contains("://"), F.element_at(F.split(url, "://"), 2)).otherwise(url)
    return F.when(is_blank(url), official).otherwise(F.element_at(F.split(rest, "/"), 1))


def decoded_project(folder: Column) -> Column:
    """Project of a folder name that stands for a path with ``-`` between its parts: the last part, null without any."""
    last = F.regexp_extract(folder, r"([^-]+)-*$", 1)
    return F.when(last != "", last)


def project_name(path: Column) -> Column:
    """Last part of a path with slashes of either kind that isn't empty."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: F.trim(x) != "")
    return F.try_element_at(parts, F.lit(-1))


def project_key(path: Column, name: Column, session_id: Column, fact_key: Column) -> Column:
    """Path, else the name, else the session, else the fact itself."""
    return (
        F.when(~is_blank(path), path)
        .when(~is_blank(name), F.concat(F.lit("name::"), name))
        .when(~is_blank(session_id), F.concat(F.lit("unknown::"), session_id))
        .otherwise(F.concat(F.lit("unknown::fact::"), fact_key))
    )


def snapshot_id(*columns: Column) -> Column:
    """Fingerprint of a row's values, null-safe."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
