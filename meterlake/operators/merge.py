"""Two observations of a request become one fact.

Local transcripts and the proxy are joined once, full outer, on the request key. All proxy rows are in the join, also
those that are not visible: a local row whose key the proxy has seen in any form must not appear as local alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.keys import is_blank, request_key, source_label
from meterlake.functions.models import model_bucket
from meterlake.functions.numbers import total_tokens
from meterlake.operators.pricing import with_cost
from meterlake.schemas import FACTS, LOCAL, LOCAL_ONLY, MERGED, PROXY, PROXY_ONLY, conform

TOKENS = ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")


def keyed_local(local: DataFrame) -> DataFrame:
    key = request_key(*(F.col(c) for c in ("request_key", "tool", "message_id", "session_id", "timestamp", "model", *TOKENS, "total_tokens")))
    return conform(local, LOCAL).withColumn("k", key)


def keyed_proxy(proxy: DataFrame) -> DataFrame:
    total = total_tokens(*(F.col(c) for c in TOKENS))
    seconds = F.expr("timestamp div 1000")
    return conform(proxy, PROXY).withColumn("k", request_key(F.col("canonical_request_key"), F.col("client_tool"), F.col("message_id"), F.col("session_id"), seconds, F.col("model"), *(F.col(c) for c in TOKENS), total))


def first_per_key(rows: DataFrame, *order: Column) -> DataFrame:
    """One row for each key, the first by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where("_n = 1").drop("_n")


def local_observations(local: DataFrame, remote: DataFrame | None = None) -> DataFrame:
    """Local rows and those of other devices, keyed; of one key the own device's earliest row stays."""
    own = keyed_local(local).withColumn("_origin", F.lit(0))
    if remote is not None:
        own = own.unionByName(keyed_local(remote).withColumn("_origin", F.lit(1)))
    return first_per_key(own, F.col("_origin"), F.col("timestamp"), *(F.col(c) for c in ("session_id", "model", "total_tokens"))).drop("_origin")


def message_sessions(messages: DataFrame) -> DataFrame:
    """(message_id, session_id): of a message's records (message_id, session_id, timestamp) the last that names a session; of equal times the greater name."""
    known = messages.where(~is_blank(F.col("message_id")) & ~is_blank(F.col("session_id")))
    return known.groupBy("message_id").agg(F.max_by("session_id", F.struct("timestamp", "session_id")).alias("session_id"))


def with_messages(records: DataFrame, ids: DataFrame, key: str = "message_id") -> DataFrame:
    """The records, however many, of a list of ids."""
    return records.join(ids.select(key).distinct(), key, "left_semi")


def proxy_observations(proxy: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Proxy rows, keyed; of one key the latest stays. ``messages`` (message_id, session_id, timestamp) fills blank sessions.

    Only rows that lack a session and have a message are joined with messages, and only with those of theirs.
    """
    own = keyed_proxy(proxy)
    if messages is not None:
        lacks, asks = is_blank(F.col("session_id")), is_blank(F.col("session_id")) & ~is_blank(F.col("message_id"))
        unnamed = own.where(asks)
        known = message_sessions(with_messages(messages, unnamed)).withColumnRenamed("session_id", "_session")
        filled = unnamed.join(known, "message_id", "left").withColumn("session_id", F.col("_session")).select(own.columns)
        own = own.where(~asks).withColumn("session_id", F.when(~lacks, F.col("session_id"))).unionByName(filled)
    return first_per_key(own, F.desc("timestamp"), F.desc("duration_ms"), F.desc("output_tokens"))


def merge_facts(
    proxy: DataFrame,
    local: DataFrame,
    remote: DataFrame | None = None,
    sessions: DataFrame | None = None,
    prices: DataFrame | None = None,
    include_errors: bool = False,
    chosen: Column | None = None,
    keep_local_only: bool = True,
    messages: DataFrame | None = None,
) -> DataFrame:
    """FACTS from both sides. Restrict the inputs to a time range beforehand: a filter on the result would change the join.

    ``chosen`` restricts proxy rows (by source, say) as visibility does: rows left out still keep local twins out.
    A source filter has no local rows: pass ``keep_local_only=False``. ``messages`` (message_id, session_id, timestamp) tell
    the session of proxy rows without one; by default the local rows do.
    """
    p_all = proxy_observations(proxy, (local if messages is None else messages).select("message_id", "session_id", "timestamp"))
    visible = F.lit(True) if include_errors else F.col("status_code").between(200, 299)
    p = p_all.withColumn("_seen", F.coalesce(visible & (chosen if chosen is not None else F.lit(True)), F.lit(False)))
    ours = local_observations(local, remote)
    if prices is not None:
        models = [conform(rows, LOCAL).select("model") for rows in (local, remote) if rows is not None]
        ours = with_cost(ours, prices, "_priced", models=models[0] if remote is None else models[0].unionByName(models[1]))
    else:
        ours = ours.withColumn("_priced", F.lit(0.0))
    p, ours = (d.select(F.col("k").alias("k"), F.struct(*(c for c in d.columns if c != "k")).alias(name)) for d, name in ((p, "p"), (ours, "l")))
    both = p.join(ours, "k", "full_outer")
    has_p, has_l = F.col("p").isNotNull(), F.col("l").isNotNull()
    shown = both.where(F.when(has_p, F.col("p._seen")).otherwise(F.lit(keep_local_only)))

    def pick(p_name: str, l_name: str, when_both: Column) -> Column:
        return F.when(has_p & has_l, when_both).when(has_p, F.col(f"p.{p_name}")).otherwise(F.col(f"l.{l_name}"))

    def text(p_name: str, l_name: str, local_first: bool) -> Column:
        first, then = (F.col(f"l.{l_name}"), F.col(f"p.{p_name}")) if local_first else (F.col(f"p.{p_name}"), F.col(f"l.{l_name}"))
        return F.coalesce(pick(p_name, l_name, F.when(is_blank(first), then).otherwise(first)), F.lit(""))

    def tokens(name: str, local_first: bool) -> Column:
        first, then = (F.col(f"l.{name}"), F.col(f"p.{name}")) if local_first else (F.col(f"p.{name}"), F.col(f"l.{name}"))
        return F.coalesce(pick(name, name, F.when(first > 0, first).otherwise(then)), F.lit(0))

    own_cost = F.coalesce(F.col("l.explicit_estimated_cost"), F.col("l._priced"), F.lit(0.0))
    seconds_p, ms_l = F.expr("p.timestamp div 1000"), F.col("l.timestamp") * 1000
    facts = shown.select(
        F.col("k").alias("canonical_request_key"),
        text("session_id", "session_id", True).alias("session_id"),
        text("client_tool", "tool", True).alias("tool"),
        text("model", "model", False).alias("_model"),
        tokens("input_tokens", False).alias("input_tokens"),
        tokens("output_tokens", False).alias("output_tokens"),
        tokens("cache_create_tokens", True).alias("cache_create_tokens"),
        tokens("cache_read_tokens", True).alias("cache_read_tokens"),
        F.when(has_l & ~has_p, F.col("l.total_tokens")).alias("_total"),
        F.when(has_l, F.col("l.timestamp")).otherwise(seconds_p).alias("timestamp_sec"),
        F.when(has_p, F.col("p.timestamp")).otherwise(ms_l).alias("timestamp_ms"),
        F.when(has_l, F.greatest(F.coalesce("l.request_count", F.lit(1)), F.lit(1))).otherwise(F.lit(1)).cast("long").alias("request_count"),
        F.when(has_p & has_l, F.when(F.col("p.cost_locked"), F.col("p.estimated_cost")).otherwise(own_cost)).when(has_p, F.col("p.estimated_cost")).otherwise(F.greatest(own_cost, F.lit(0.0))).alias("estimated_cost"),
        F.when(has_p & has_l, MERGED).when(has_p, PROXY_ONLY).otherwise(LOCAL_ONLY).alias("coverage_origin"),
        F.when(has_p, F.col("p.status_code")).otherwise(F.lit(200)).alias("status_code"),
        *(F.col(f"p.{c}").alias(c) for c in ("duration_ms", "output_tokens_per_second", "ttft_ms", "api_key_prefix", "request_base_url")),
    )
    facts = facts.withColumns({"model": model_bucket(F.col("tool"), F.col("_model")), "total_tokens": F.coalesce("_total", total_tokens(*(F.col(c) for c in TOKENS))), "source_label": source_label(F.col("api_key_prefix"), F.col("request_base_url"))})
    if sessions is not None:
        facts = with_session(facts, sessions)
    return conform(facts, FACTS)


def with_session(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """``facts`` with project name and path of their session; of repeated sessions the one changed last."""
    meta = sessions.groupBy("session_id").agg(F.max_by(F.struct("project_name", "cwd"), F.struct(F.coalesce("last_modified", F.lit(0)), "tool")).alias("_m")).select(F.col("session_id"), F.col("_m.project_name").alias("project_name"), F.col("_m.cwd").alias("project_path"))
    return facts.drop("project_name", "project_path").join(meta, "session_id", "left")
