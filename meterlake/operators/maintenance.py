"""Keeping stores in order: counts, bounds, orphans, duplicates, retention, versions and feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.keys import is_blank

#: Session of legacy records that none could be found for.
UNMATCHED = "__legacy_unmatched__"


def signature(rows: DataFrame, ts: str, version: str | None = None) -> DataFrame:
    """What changes when rows do: their number, the latest time and the highest version."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.max(ts), F.lit(0)).alias("max_ts"), F.coalesce(F.max(version) if version else F.lit(0), F.lit(0)).alias("max_version"))


def time_bounds(*times: DataFrame) -> DataFrame:
    """First and last of the single column of several frames."""
    union = times[0].toDF("t")
    for t in times[1:]:
        union = union.union(t.toDF("t"))
    return union.agg(F.min("t").alias("first"), F.max("t").alias("last"))


def orphan_facts(facts: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Facts whose source file is known to be gone."""
    gone = files.where(~F.col("present")).select("source_file_id").distinct()
    return facts.join(gone, "source_file_id", "left_semi")


def purged(facts: DataFrame, sessions: DataFrame, orphans: DataFrame, key: str, before: int) -> tuple[DataFrame, DataFrame]:
    """(facts, sessions) without orphans older than a moment, and without the sessions that only those had."""
    old = orphans.where(F.col("timestamp") < before)
    kept = facts.join(old.select(key), key, "left_anti")
    emptied = old.select("session_id").distinct().join(kept.select("session_id").distinct(), "session_id", "left_anti")
    return kept, sessions.join(emptied, "session_id", "left_anti")


def changed_keys(cached: DataFrame, current: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, change): new, dirty or removed, by comparing fingerprints; equal ones are left out."""
    a, b = cached.select(key, F.col(fingerprint).alias("_a")), current.select(key, F.col(fingerprint).alias("_b"))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "dirty")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def latest_versions(rows: DataFrame, keys: Sequence[str], seq: str, *ties: str) -> DataFrame:
    """Of each key the row of the highest sequence number; of equal ones the one that came last."""
    order = Window.partitionBy(*keys).orderBy(F.desc(seq), *(F.desc(t) for t in ties))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merged_settings(versions: DataFrame) -> DataFrame:
    """Of each field the value written last (ties: the greater device)."""
    return versions.groupBy("field").agg(F.max_by("value", F.struct("updated_at", "device_id")).alias("value"), F.max("updated_at").alias("updated_at"))


def applied_batches(batches: DataFrame) -> DataFrame:
    """Batches of each device up to the first break in their numbers."""
    order = Window.partitionBy("device_id").orderBy("seq")
    broken = F.coalesce((F.col("seq") - F.lag("seq").over(order) != 1).cast("int"), F.lit(0))
    return batches.withColumn("_b", broken).withColumn("_broken", F.sum("_b").over(order)).where("_broken = 0").drop("_b", "_broken")


def newest(rows: DataFrame, n: int, order: str, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(n)


def retained(records: DataFrame, since_ms: int) -> DataFrame:
    return records.where(F.col("timestamp") >= since_ms)


def without(records: DataFrame, chosen: Column) -> DataFrame:
    return records.where(~F.coalesce(chosen, F.lit(False)))


def devices(remote: DataFrame) -> DataFrame:
    """Other devices (device_id) with the number and the time of what has come from them."""
    return remote.groupBy("device_id").agg(F.count("*").alias("facts"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def without_device(remote: DataFrame, device: str | None, day: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, (day) of those that go) when a device's rows are dropped; those of all devices for None."""
    gone = F.lit(True) if device is None else F.coalesce(F.col("device_id") == device, F.lit(False))
    return remote.where(~gone), remote.where(gone).select(day.alias("day")).distinct()


def merged_sources(sources: DataFrame, into: str, from_: str) -> DataFrame:
    """Two sources of one base url become one with the prefixes of both; sources of different urls stay as they are."""
    pair = sources.where(F.col("id").isin(into, from_))
    both = pair.agg(F.count("*").alias("_n"), F.count_distinct(F.coalesce("base_url", F.lit(""))).alias("_urls"), F.array_distinct(F.flatten(F.collect_list("api_key_prefixes"))).alias("_all"))
    joined = sources.join(F.broadcast(both), F.lit(True))
    fits = (F.col("_n") == 2) & (F.col("_urls") == 1)
    return joined.where(~(fits & (F.col("id") == from_))).select(*(F.when(fits & (F.col("id") == into), F.array_sort("_all")).otherwise(F.col(c)).alias(c) if c == "api_key_prefixes" else F.col(c) for c in sources.columns))


def new_sources(records: DataFrame, known: DataFrame) -> DataFrame:
    """(prefix, url) pairs of requests that no configured source has, with when they were seen."""
    pairs = known.select(F.explode("api_key_prefixes").alias("api_key_prefix"), F.coalesce("base_url", F.lit("")).alias("_url")).distinct()
    seen = records.where("api_key_prefix IS NOT NULL").groupBy("api_key_prefix", F.coalesce("request_base_url", F.lit("")).alias("_url")).agg(F.min("timestamp").alias("first_seen_ms"), F.max("timestamp").alias("last_seen_ms"))
    return seen.join(pairs, ["api_key_prefix", "_url"], "left_anti").withColumnRenamed("_url", "base_url")


def legacy_sessions(records: DataFrame, messages: DataFrame) -> DataFrame:
    """Session totals of records without a session, by their message; those that match none go to one sentinel session."""
    known = messages.where(~is_blank(F.col("message_id"))).groupBy("message_id").agg(F.min("session_id").alias("_s"))
    own = records.where(is_blank(F.col("session_id"))).join(known, "message_id", "left").withColumn("session_id", F.coalesce("_s", F.lit(UNMATCHED)))
    return own.groupBy("session_id").agg(
        F.count("*").alias("requests"),
        *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")),
        F.min("timestamp").alias("first_ms"),
        F.max("timestamp").alias("last_ms"),
        F.count_distinct("model").alias("models"),
        F.coalesce(F.avg(F.when(F.col("ttft_ms") > 0, F.col("ttft_ms"))), F.lit(0.0)).alias("avg_ttft_ms"),
        F.coalesce(F.try_divide(F.sum("output_tokens") * 1000.0, F.sum("duration_ms")), F.lit(0.0)).alias("rate"),
    )


def renamed_sessions(records: DataFrame, prefix: str, to: str) -> DataFrame:
    """Session ids with an old prefix get the new one."""
    return records.withColumn("session_id", F.when(F.col("session_id").startswith(prefix), F.concat(F.lit(to), F.substring("session_id", len(prefix) + 1, 1_000_000))).otherwise(F.col("session_id")))


def seeded(outbox: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The outbox with every fact that it lacks."""
    return outbox.unionByName(facts.join(outbox.select(key), key, "left_anti").select(outbox.columns))


_OUTBOX = ("event_id", "payload", "queued_at", "batched_seq", "uploaded_at")


def enqueued(outbox: DataFrame, events: DataFrame, at: int) -> DataFrame:
    """The outbox (event_id, payload, queued_at, batched_seq, uploaded_at) with events (event_id, payload); one that is there already is queued anew."""
    kept = outbox.join(events.select("event_id"), "event_id", "left_anti").select(*_OUTBOX)
    none = F.lit(None).cast("long")
    return kept.unionByName(events.groupBy("event_id").agg(F.max("payload").alias("payload")).select("event_id", "payload", F.lit(at).cast("long").alias("queued_at"), none.alias("batched_seq"), none.alias("uploaded_at")))


def reserved(outbox: DataFrame, seq: int, limit: int) -> DataFrame:
    """The ``limit`` events that have waited longest are put in batch ``seq``."""
    waiting = outbox.where("batched_seq IS NULL AND uploaded_at IS NULL").orderBy("queued_at", "event_id").limit(limit).select("event_id", F.lit(True).alias("_taken"))
    return outbox.join(F.broadcast(waiting), "event_id", "left").withColumn("batched_seq", F.when(F.col("_taken"), F.lit(seq).cast("long")).otherwise(F.col("batched_seq"))).select(*_OUTBOX)


def released(outbox: DataFrame, seq: int) -> DataFrame:
    """A batch that could not be sent: its events wait again."""
    return outbox.withColumn("batched_seq", F.when((F.col("batched_seq") == seq) & F.col("uploaded_at").isNull(), None).otherwise(F.col("batched_seq")))


def marked_uploaded(outbox: DataFrame, seq: int, at: int) -> DataFrame:
    return outbox.withColumn("uploaded_at", F.when((F.col("batched_seq") == seq) & F.col("uploaded_at").isNull(), F.lit(at).cast("long")).otherwise(F.col("uploaded_at")))


def without_uploaded(outbox: DataFrame, before: int) -> DataFrame:
    return outbox.where(F.col("uploaded_at").isNull() | (F.col("uploaded_at") >= before))


def synced_facts(stored: DataFrame, parsed: DataFrame, dirty: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Stored facts after the dirty sessions (session_id) were parsed anew: their facts replace stored ones of the same key.

    Facts of a dirty session that it no longer has stay, marked as absent. Both kinds get the next version; the facts of other
    sessions are as they were. Facts have source_file_present and sync_version beside their values; ``parsed`` needs neither.
    """
    present, version = "source_file_present", "sync_version"
    values = [c for c in stored.columns if c not in (key, present, version)]
    old = stored.join(dirty.select("session_id").distinct(), "session_id", "left_semi").select(key, F.struct(*values).alias("_old"), F.col(version).alias("_v"))
    new = parsed.select(key, F.struct(*values).alias("_new"))
    both = old.join(new, key, "full_outer")
    done = both.select(key, F.coalesce("_new", "_old").alias("x"), F.col("_new").isNotNull().alias(present), (F.coalesce("_v", F.lit(0)) + 1).alias(version)).select(key, "x.*", present, version)
    rest = stored.join(dirty.select("session_id").distinct(), "session_id", "left_anti")
    moved = rest.join(new.select(key), key, "left_anti")  # a key that another session has now leaves its old one
    return moved.unionByName(done.select(stored.columns))


def touched_days(before: DataFrame, after: DataFrame, day: Column, key: str = "dedupe_key", version: str = "sync_version") -> DataFrame:
    """(day): days whose facts are new, gone, or of another version."""
    a, b = (d.select(key, version, day.alias("day")) for d in (before, after))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("day").distinct()


def proxy_days(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Proxy records by UTC day: the daily rollup, and with ``by`` that of models."""
    day = F.timestamp_millis("timestamp").cast("date").cast("string").alias("day")
    return records.groupBy(day, *by).agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")), F.sum("estimated_cost").alias("cost"), F.count_if(F.col("status_code").between(200, 299)).alias("success_requests"), F.count_if(F.col("status_code") >= 400).alias("error_requests"), F.count_distinct("session_id").alias("sessions"))


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status_code").agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "status_code")
