"""Sessions and projects: facts rolled up, sessions without facts beside them, and how well they are covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.keys import is_blank, project_key, project_name
from meterlake.functions.models import model_id
from meterlake.functions.numbers import total_tokens
from meterlake.operators.metrics import _sum, _weight
from meterlake.schemas import LOCAL_ONLY

_TOKENS = ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")
GRACE_SECONDS, MATCH_SECONDS = 30, 15


def session_rollup(facts: DataFrame) -> DataFrame:
    """One row for each session of the facts. Requests count facts; success is a status below 400.

    Where some facts are local alone, status counts would be half the truth: they are zero.
    """
    status, local = F.col("status_code"), F.col("coverage_origin") == LOCAL_ONLY
    rate, ttft = F.col("output_tokens_per_second"), F.col("ttft_ms")
    out = facts.where(~is_blank(F.col("session_id"))).groupBy("session_id").agg(
        F.min("tool").alias("tool"),
        F.max("project_name").alias("project_name"),
        F.max("project_path").alias("project_path"),
        F.count("*").alias("requests"),
        F.sum(_weight()).alias("weighted_requests"),
        *(_sum(F.col(c)).alias(c) for c in (*_TOKENS, "total_tokens")),
        _sum(F.col("estimated_cost"), otherwise=0.0).alias("cost"),
        F.min("timestamp_sec").alias("first_request"),
        F.max("timestamp_sec").alias("last_request"),
        F.array_sort(F.collect_set(F.when(F.trim("model") != "", F.col("model")))).alias("models"),
        F.coalesce(F.avg(F.when(rate > 0, rate)), F.lit(0.0)).alias("avg_rate"),
        F.coalesce(F.avg(F.when(ttft > 0, ttft)), F.lit(0.0)).alias("avg_ttft_ms"),
        _sum(F.lit(1), (status < 400) & ~local).alias("_success"),
        _sum(F.lit(1), (status >= 400) & ~local).alias("_errors"),
        _sum(F.lit(1), ~local).alias("proxy_backed"),
        _sum(F.lit(1), local).alias("local_only"),
    )
    partial = (F.col("proxy_backed") > 0) & (F.col("local_only") > 0)
    return out.withColumns({"is_partial": partial, "success_requests": F.when(partial, 0).otherwise(F.col("_success")), "error_requests": F.when(partial, 0).otherwise(F.col("_errors"))}).drop("_success", "_errors")


def _from_metadata() -> list[Column]:
    """A session's own columns in the shape of ``session_rollup``."""
    zero = F.lit(0).cast("long")
    return [
        F.col("session_id"),
        F.col("tool"),
        F.col("project_name"),
        F.col("cwd").alias("project_path"),
        F.coalesce("request_count", zero).alias("requests"),
        F.coalesce("request_count", zero).alias("weighted_requests"),
        *(F.coalesce(c, zero).alias(c) for c in _TOKENS),
        total_tokens(*(F.coalesce(c, zero) for c in _TOKENS)).alias("total_tokens"),
        F.coalesce("estimated_cost", F.lit(0.0)).alias("cost"),
        F.col("start_time").alias("first_request"),
        F.greatest("end_time", "last_modified").alias("last_request"),
        F.array_sort("models").alias("models"),
        F.lit(0.0).alias("avg_rate"),
        F.lit(0.0).alias("avg_ttft_ms"),
        zero.alias("proxy_backed"),
        zero.alias("local_only"),
        F.lit(False).alias("is_partial"),
        zero.alias("success_requests"),
        zero.alias("error_requests"),
    ]


def metadata_only(sessions: DataFrame, rolled: DataFrame) -> DataFrame:
    """Sessions that no fact belongs to, in the shape of ``session_rollup``."""
    return sessions.join(rolled.select("session_id"), "session_id", "left_anti").select(*_from_metadata())


def all_sessions(facts: DataFrame, sessions: DataFrame, with_metadata_only: bool = True) -> DataFrame:
    """Every session, with facts or without; those without only where no source is filtered for.

    Facts are merged and rolled up once: sessions and their metadata meet in one full outer join.
    """
    rolled = session_rollup(facts)
    if not with_metadata_only:
        return rolled.withColumn("has_facts", F.lit(True))
    bare = sessions.select(*_from_metadata()).select(*rolled.columns)
    bare = bare.groupBy(F.col("session_id").alias("_id")).agg(F.collect_list(F.struct(*rolled.columns)).alias("_bare"))
    both = rolled.withColumn("_rolled", F.lit(True)).join(bare, F.col("session_id") == F.col("_id"), "full_outer")
    own = F.array(F.struct(*rolled.columns))
    shown = both.select(F.explode(F.when(F.col("_rolled"), own).otherwise(F.col("_bare"))).alias("_s"), F.coalesce("_rolled", F.lit(False)).alias("has_facts"))
    return shown.select("_s.*", "has_facts")


def latest(sessions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return sessions.orderBy(F.desc_nulls_last("last_request"), "session_id").offset(offset).limit(limit)


def project_rollup(facts: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, tools of projects): facts and, for sessions without facts, what their metadata says. Requests count weights."""
    key = project_key(F.col("project_path"), F.col("project_name"), F.col("session_id"), F.col("canonical_request_key"))
    local = F.col("coverage_origin") == LOCAL_ONLY
    own = facts.select(key.alias("project_key"), F.coalesce(project_name(F.col("project_path")), F.col("project_name")).alias("name"), "tool", "session_id", _weight().alias("requests"), "total_tokens", F.col("estimated_cost").alias("cost"), F.col("timestamp_sec").alias("seen"), F.when(local, 0).otherwise(_weight()).alias("covered"))
    bare = metadata_only(sessions, facts.select("session_id").distinct())
    bare_key = project_key(F.col("project_path"), F.col("project_name"), F.col("session_id"), F.lit(""))
    rest = bare.select(bare_key.alias("project_key"), F.coalesce(project_name(F.col("project_path")), F.col("project_name")).alias("name"), "tool", "session_id", F.col("requests").alias("requests"), "total_tokens", "cost", F.col("last_request").alias("seen"), F.lit(0).cast("long").alias("covered"))
    # one row for each project, tool and session first: distinct sessions are then plain counts
    by_session = own.unionByName(rest).groupBy("project_key", "tool", "session_id").agg(F.max("name").alias("name"), *(F.sum(c).alias(c) for c in ("requests", "total_tokens", "cost", "covered")), F.max("seen").alias("seen"))

    def rolled(*by: str) -> DataFrame:
        named = F.count_distinct(F.when(~is_blank(F.col("session_id")), F.col("session_id")))
        return by_session.groupBy(*by).agg(F.max("name").alias("name"), named.alias("sessions"), *(F.sum(c).alias(c) for c in ("requests", "total_tokens", "cost", "covered")), F.max("seen").alias("last_active"))

    return rolled("project_key").orderBy(F.desc("last_active"), "project_key"), rolled("project_key", "tool").drop("name").orderBy("project_key", F.desc("last_active"), "tool")


def nested_projects(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Projects with their tools as an array of structs, latest first."""
    projects, tools = project_rollup(facts, sessions)
    item = F.struct((-F.col("last_active")).alias("_order"), "tool", "sessions", "requests", "total_tokens", "cost", "last_active")
    nested = tools.groupBy("project_key").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("_order")).alias("tools"))
    return projects.join(nested, "project_key", "left")


def _in_session(seconds: Column, grace: int) -> Column:
    start = F.when(F.col("start_time") > 0, F.col("start_time")).otherwise(F.col("last_modified") - 15)
    end = F.greatest("end_time", "last_modified")
    return (seconds >= start - grace) & (seconds <= F.when(end > 0, end).otherwise(start + 15) + grace)


def session_candidates(requests: DataFrame, sessions: DataFrame, row: str, seconds: str, model: str = "model", grace: int = MATCH_SECONDS, hours: int = 6) -> DataFrame:
    """(row, session_id) for each session of the same model (or of none) whose time the request falls in.

    Sessions are dealt to the slots of ``hours`` that they touch (shorter ones without a model), so that the join is by slot and
    model, not of all pairs.
    """
    start = F.when(F.col("start_time") > 0, F.col("start_time")).otherwise(F.col("last_modified") - 15) - grace
    end = F.greatest(F.greatest("end_time", "last_modified"), start + 15 + grace) + grace
    known = sessions.where(~is_blank(F.col("session_id")))
    asked = requests.select(row, F.col(seconds).alias("_at"), model_id(F.col(model)).alias("_name"))

    def slots(step: int) -> Column:
        return F.explode(F.sequence(F.floor(start / step), F.floor(end / step)))

    def at(step: int) -> Column:
        return F.floor(F.col("_at") / step)

    coarse, fine = hours * 3600, max(60, hours * 150)
    named = known.where(F.size("models") > 0).withColumn("_slot", slots(coarse)).withColumn("_name", F.explode(F.array_distinct(F.transform("models", lambda m: model_id(m)))))
    # sessions without a model meet requests of all models: in slots so short that few sessions share one
    bare = known.where(~(F.coalesce(F.size("models"), F.lit(0)) > 0)).withColumn("_slot", slots(fine))
    met = [asked.withColumn("_slot", at(coarse)).join(named, ["_slot", "_name"]), asked.withColumn("_slot", at(fine)).join(bare, "_slot")]
    return met[0].where(_in_session(F.col("_at"), grace)).select(row, "session_id").unionByName(met[1].where(_in_session(F.col("_at"), grace)).select(row, "session_id")).distinct()


#: Seconds of an hour, within which sums run in one task.
SLOT = 3600


def _lone_and_repeated(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions with an id, those that have one row and those that have several."""
    known = sessions.where(~is_blank(F.col("session_id")))
    several = known.groupBy("session_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("session_id")
    return known.join(several, "session_id", "left_anti"), known.join(several, "session_id", "left_semi")


def _spans(sessions: DataFrame, grace: int) -> DataFrame:
    """(session_id, kind, lo, hi): the seconds of each session, once for each of its models, or once for all models if it has none."""
    start = F.when(F.col("start_time") > 0, F.col("start_time")).otherwise(F.col("last_modified") - 15)
    end = F.greatest("end_time", "last_modified")
    names = F.when(F.size("models") > 0, F.array_distinct(F.transform("models", lambda m: F.concat(F.lit("model "), model_id(m))))).otherwise(F.array(F.lit("any")))
    spans = sessions.select("session_id", F.explode(names).alias("kind"), (start - grace).alias("lo"), (F.when(end > 0, end).otherwise(start + 15) + grace).alias("hi"))
    return spans.where("lo <= hi")


def _swept(events: DataFrame, sums: list[str]) -> DataFrame:
    """``events`` (kind, t, step, ...) with running sums over each kind by time, then step.

    A kind's sums are carried from hour to hour, and run within an hour: a kind that many events share lies in many tasks.
    """
    hour = F.expr(f"t div {SLOT}")
    dealt = events.withColumn("_slot", hour)
    totals = dealt.groupBy("kind", "_slot").agg(*(F.sum(c).alias(f"_t{c}") for c in sums))
    before = Window.partitionBy("kind").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("kind", "_slot", *(F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_c{c}") for c in sums))
    inside = Window.partitionBy("kind", "_slot").orderBy("t", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(carried, ["kind", "_slot"]).select(*events.columns, *((F.sum(c).over(inside) + F.col(f"_c{c}")).alias(f"sum_{c}") for c in sums))


def _asked(requests: DataFrame, row: str, seconds: str, model: str) -> DataFrame:
    """(row, t, kind): each request under its model, and under all."""
    kinds = F.array(F.concat(F.lit("model "), model_id(F.col(model))), F.lit("any"))
    return requests.where(F.col(seconds).isNotNull()).select(F.col(row).alias("row"), F.col(seconds).cast("long").alias("t"), F.explode(kinds).alias("kind"))


def resolved_sessions(requests: DataFrame, sessions: DataFrame, row: str, seconds: str, model: str = "model", grace: int = MATCH_SECONDS) -> DataFrame:
    """(row, session_id, state): known with a single candidate, else ambiguous or unmatched. ``row`` names a request once.

    Nothing lists the candidates: sessions open and close along the time, and each request reads how many are open and the sum of their hashed ids,
    which is that of the only one if there is one. Only sessions of several rows, which must not count twice, are met in pairs.
    """
    lone, repeated = _lone_and_repeated(sessions)
    h = {"a": F.xxhash64("session_id").cast("decimal(38,0)"), "b": F.xxhash64(F.lit("b"), "session_id").cast("decimal(38,0)")}
    spans = _spans(lone, grace).withColumns({"n": F.lit(1).cast("long"), **h})
    opens = spans.select("kind", F.col("lo").cast("long").alias("t"), F.lit(0).alias("step"), F.lit(None).cast(requests.schema[row].dataType).alias("row"), "n", "a", "b")
    closes = spans.select("kind", F.col("hi").cast("long").alias("t"), F.lit(2).alias("step"), F.lit(None).cast(requests.schema[row].dataType).alias("row"), *((-F.col(c)).alias(c) for c in ("n", "a", "b")))
    nothing = F.lit(0).cast("decimal(38,0)")
    reads = _asked(requests, row, seconds, model).select("kind", "t", F.lit(1).alias("step"), "row", F.lit(0).cast("long").alias("n"), nothing.alias("a"), nothing.alias("b"))
    swept = _swept(opens.unionByName(reads).unionByName(closes), ["n", "a", "b"]).where("step = 1").select("row", F.col("sum_n").alias("n"), F.col("sum_a").cast("decimal(38,0)").alias("a"), F.col("sum_b").cast("decimal(38,0)").alias("b"))
    paired = session_candidates(requests, repeated, row, seconds, model, grace).select(F.col(row).alias("row"), F.lit(1).cast("long").alias("n"), h["a"].alias("a"), h["b"].alias("b"))
    found = swept.unionByName(paired).groupBy(F.col("row").alias(row)).agg(F.sum("n").alias("_n"), *(F.sum(c).cast("decimal(38,0)").alias(f"_{c}") for c in ("a", "b")))
    ids = sessions.where(~is_blank(F.col("session_id"))).select("session_id").distinct().select(F.col("session_id").alias("_s"), h["a"].alias("_a"), h["b"].alias("_b"))
    named = found.join(ids, ["_a", "_b"], "left")
    state = F.when(F.col("_n") == 1, "known").when(F.col("_n") > 1, "ambiguous").otherwise("unmatched")
    return requests.select(row).join(named, row, "left").select(row, F.when(F.col("_n") == 1, F.col("_s")).alias("session_id"), state.alias("state"))


def unresolved_per_session(requests: DataFrame, sessions: DataFrame, row: str, seconds: str, model: str = "model", grace: int = MATCH_SECONDS) -> DataFrame:
    """How many unresolved requests may belong to each session: those up to its end less those before its start, of its models."""
    lone, repeated = _lone_and_repeated(sessions)
    spans = _spans(lone, grace)
    none = F.lit(None).cast(sessions.schema["session_id"].dataType)
    edges = [spans.select("kind", F.col(c).cast("long").alias("t"), F.lit(step).alias("step"), "session_id", F.lit(sign).cast("long").alias("sign"), F.lit(0).cast("long").alias("n")) for c, step, sign in (("lo", 0, -1), ("hi", 2, 1))]
    asked = _asked(requests, row, seconds, model).select("kind", "t", F.lit(1).alias("step"), none.alias("session_id"), F.lit(0).cast("long").alias("sign"), F.lit(1).cast("long").alias("n"))
    swept = _swept(edges[0].unionByName(edges[1]).unionByName(asked), ["n"]).where("step <> 1").groupBy("session_id").agg(F.sum(F.col("sign") * F.col("sum_n")).alias("unresolved"))
    paired = session_candidates(requests, repeated, row, seconds, model, grace).groupBy("session_id").agg(F.count("*").alias("unresolved"))
    return swept.where("unresolved > 0").unionByName(paired)


def session_coverage(sessions: DataFrame, rolled: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(session_id, state): covered if all its requests are facts and they span its time but for a grace, partial otherwise, none without facts."""
    both = sessions.select("session_id", F.col("request_count").alias("_want"), "start_time", "end_time").join(rolled.select("session_id", "requests", "first_request", "last_request"), "session_id", "left").join(unresolved, "session_id", "left")
    spans = (F.col("first_request") <= F.col("start_time") + GRACE_SECONDS) & (F.col("last_request") >= F.col("end_time") - GRACE_SECONDS)
    full = (F.col("requests") == F.col("_want")) & spans & (F.coalesce("unresolved", F.lit(0)) == 0)
    return both.select("session_id", F.coalesce("unresolved", F.lit(0)).alias("unresolved"), F.when(F.col("requests").isNull(), "none").when(full, "covered").otherwise("partial").alias("state"))


def proxy_sessions(records: DataFrame) -> DataFrame:
    """Proxy records by session: tool ``mixed`` where there are several, models joined, rate as all tokens over all time."""
    tools = F.count_distinct("client_tool")
    return records.where(~is_blank(F.col("session_id"))).groupBy("session_id").agg(
        F.when(tools > 1, "mixed").otherwise(F.min("client_tool")).alias("tool"),
        F.count("*").alias("requests"),
        *(F.sum(c).alias(c) for c in _TOKENS),
        F.sum("estimated_cost").alias("cost"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.coalesce(F.avg(F.when(F.col("ttft_ms") > 0, F.col("ttft_ms"))), F.lit(0.0)).alias("avg_ttft_ms"),
        F.coalesce(F.try_divide(F.sum("output_tokens") * 1000.0, F.sum("duration_ms")), F.lit(0.0)).alias("avg_rate"),
        F.min("timestamp").alias("first_ms"),
        F.max("timestamp").alias("last_ms"),
    )
