"""Queries: filters, scalar functions, sequences, sets and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions import keys, models, numbers
from meterlake.operators import filters, maintenance, presentation, sequences
from meterlake.operators.merge import message_sessions, with_messages
from meterlake.operators.statistics import model_table, trend
from meterlake.queries.bindings import BASE_CTE, END, METRICS_SQL, SOURCES, START, facts, local, proxy, read, remote, sessions
from meterlake.queries.registry import query, rounded


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.lit(name).alias("filter"), F.count("*").alias("n"))


_UNKNOWN = "NOT coalesce((request_base_url IS NULL AND api_key_prefix IN ('sk-0', 'sk-1')) OR (request_base_url = 'https://api1.example.com/v1' AND api_key_prefix IN ('sk-1', 'sk-2')), false)"


@query(
    BASE_CTE
    + f"""SELECT 'family' AS filter, count(*) AS n FROM proxy WHERE client_tool IN ('qoder_ide', 'qoder_cli') UNION ALL SELECT 'some', count(*) FROM proxy WHERE client_tool IN ('codex', 'x')
UNION ALL SELECT 'nothing', 0 UNION ALL SELECT 'blank', count(*) FROM proxy UNION ALL SELECT 'source', count(*) FROM proxy WHERE request_base_url IS NULL AND api_key_prefix IN ('sk-0', 'sk-1')
UNION ALL SELECT 'unknown', count(*) FROM proxy WHERE {_UNKNOWN} UNION ALL SELECT 'visible', count(*) FROM proxy WHERE status_code BETWEEN 200 AND 299 UNION ALL SELECT 'stored', count(*) FROM proxy WHERE status_code < 300
UNION ALL SELECT 'range', count(*) FROM proxy WHERE timestamp >= {START * 1000} AND timestamp < {END * 1000} UNION ALL SELECT 'keyset', count(*) FROM proxy WHERE timestamp > {START * 1000} UNION ALL SELECT 'tokens', count(*) FROM proxy WHERE input_tokens + output_tokens > 0"""
)
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filter in one pass: each row says which filters it passes."""
    p = proxy(spark, sf_dir)
    prefix, url, tool, ms, status = (F.col(c) for c in ("api_key_prefix", "request_base_url", "client_tool", "timestamp", "status_code"))
    passes = {
        "family": filters.tool_in(tool, "qoder_ide"),
        "some": filters.tool_in(tool, ["codex", "x"]),
        "nothing": filters.tool_in(tool, []),
        "blank": filters.tool_in(tool, " "),
        "source": filters.source_filter(prefix, url, SOURCES, "src-a"),
        "unknown": filters.source_filter(prefix, url, SOURCES, filters.UNKNOWN_SOURCE),
        "visible": filters.visible_at_merge(status),
        "stored": filters.visible_in_store(status),
        "range": filters.in_range(ms, START * 1000, END * 1000),
        "keyset": filters.after_key(ms, F.col("event_id"), START * 1000, 10**12),
        "tokens": filters.counts_tokens(F.col("input_tokens"), F.col("output_tokens")),
    }
    counts = p.agg(*(F.count_if(c).alias(n) for n, c in passes.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.col(n).alias("n")) for n in passes))).alias("x")).select("x.*")


#: Names as tools write them: with a path, with a date of either form, opaque, in any case.
_RAW = "CASE p_partkey % 6 WHEN 0 THEN concat('Vendor/', p_name, '-2024-03-05') WHEN 1 THEN concat(p_name, '-20240101') WHEN 2 THEN concat(' ', p_name, ' ') WHEN 3 THEN 'Custom_Model' WHEN 4 THEN '-2024-03-05' ELSE concat('a/b/', upper(p_name)) END"


@query(
    rf"""SELECT p_partkey, raw, lower(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) AS id, lower(regexp_replace(raw, '^.*/', '')) AS base, CASE WHEN lower(trim(raw)) IN ('', 'unknown', 'custom_model') THEN 'Qoder CLI' ELSE trim(raw) END AS bucket,
regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^.*/', ''), '^(.+)-\d{{4}}-\d{{2}}-\d{{2}}$', '\1'), '^(.+)-\d{{8}}$', '\1') AS dated FROM (SELECT p_partkey, {_RAW} AS raw FROM part)"""
)
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "part").select("p_partkey", F.expr(_RAW).alias("raw"))
    return raw.select("p_partkey", "raw", models.model_id(F.col("raw")).alias("id"), models.base_model(F.col("raw")).alias("base"), models.model_bucket(F.lit("qoder_cli"), F.col("raw")).alias("bucket"), models.dated_model(F.col("raw")).alias("dated"))


@query(
    BASE_CTE
    + """SELECT DISTINCT api_key_prefix, request_base_url, substr(sha256(concat(coalesce(api_key_prefix, ''), '|', coalesce(request_base_url, ''))), 1, 16) AS id,
CASE WHEN request_base_url IS NULL THEN '__official_api__' ELSE regexp_extract(request_base_url, '://([^/]*)', 1) END AS host, coalesce(api_key_prefix, request_base_url) AS label, substr(api_key_prefix, 1, 3) AS short FROM proxy"""
)
def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix, url = F.col("api_key_prefix"), F.col("request_base_url")
    return proxy(spark, sf_dir).select(prefix, url).distinct().select(prefix, url, keys.source_id(prefix, url).alias("id"), keys.host_label(keys.normalized_base_url(url)).alias("host"), keys.source_label(prefix, url).alias("label"), keys.key_prefix(prefix, 3).alias("short"))


@query("SELECT url, regexp_extract(rtrim(replace(url, '\\', '/'), '/'), '([^/]*)$', 1) AS project, CASE WHEN length(url) > 20 THEN substr(url, 1, 20) || '...' ELSE url END AS short FROM pages")
def project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("url", keys.project_name(F.col("url")).alias("project"), numbers.shortened(F.col("url"), 20).alias("short"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS at FROM events")
def coerced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and times under several names: the first that is there counts."""
    ev = read(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    doc = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("ms").alias("time"), F.get_json_object("props", "$.k").alias("kk")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.floor(F.col("ms") / 1000).alias("created"), F.get_json_object("props", "$.k").cast("double").alias("k")))).otherwise(F.to_json(F.struct(F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.get_json_object("props", "$.k").cast("int").alias("kk"))))
    return ev.select("event_id", numbers.first_number(doc, ["$.k", "$.kk"]).alias("k"), numbers.first_time(doc, ["$.timestamp", "$.created", "$.time"]).alias("at"))


@query("SELECT o_orderkey, i, (t // n) + CASE WHEN i < t % n THEN 1 ELSE 0 END AS part, CASE WHEN n <= 1 THEN 1000 ELSE 1000 + 9000 * i // (n - 1) END AS at FROM (SELECT o_orderkey, n, t, unnest(generate_series(0, n - 1)) AS i FROM (SELECT o_orderkey, o_custkey % 5 + 1 AS n, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders))")
def spread_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t, i = F.col("n"), F.col("t"), F.col("i").cast("long")
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5 + 1).alias("n"), F.floor("o_totalprice").cast("long").alias("t"))
    return o.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).select("o_orderkey", "i", numbers.share_of(t, i, n).alias("part"), numbers.spread_between(F.lit(1000).cast("long"), F.lit(10_000).cast("long"), i, n).alias("at"))


@query(BASE_CTE + "SELECT message_id, input_tokens - least(cache_read_tokens, input_tokens) AS clamped_input, least(cache_read_tokens, input_tokens) AS clamped_read, greatest(input_tokens - cache_read_tokens, 0) AS plain_input, cache_read_tokens AS plain_read, round(coalesce(100.0 * cache_read_tokens / nullif(input_tokens + cache_create_tokens + cache_read_tokens, 0), 0), 4) AS hit, input_tokens + cache_read_tokens AS display FROM proxy")
def cache_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, c, r = (F.col(x) for x in ("input_tokens", "cache_create_tokens", "cache_read_tokens"))
    a, b = numbers.without_cache(i, r, True), numbers.without_cache(i, r, False)
    return rounded(proxy(spark, sf_dir).select("message_id", a["input"].alias("clamped_input"), a["cache_read"].alias("clamped_read"), b["input"].alias("plain_input"), b["cache_read"].alias("plain_read"), numbers.cache_hit_percent(i, c, r).alias("hit"), presentation.display_input(i, r).alias("display")))


@query(BASE_CTE + "SELECT message_id, round(estimated_cost * 0.9 + 1e-9, 4) AS eur, round(estimated_cost + 1e-9, 4) AS xyz, round(coalesce(estimated_cost * input_tokens / nullif(input_tokens + output_tokens, 0), 0) + 1e-9, 4) AS input_cost, CASE WHEN status_code BETWEEN 200 AND 299 THEN '2xx' WHEN status_code BETWEEN 400 AND 499 THEN '4xx' WHEN status_code >= 500 THEN '5xx' ELSE 'other' END AS class, CASE WHEN n >= 1000000000 THEN concat((n + 50000000) // 1000000000, '.', (n + 50000000) // 100000000 % 10, 'B') WHEN n >= 1000000 THEN concat((n + 50000) // 1000000, '.', (n + 50000) // 100000 % 10, 'M') WHEN n >= 1000 THEN concat((n + 50) // 1000, '.', (n + 50) // 100 % 10, 'K') ELSE CAST(n AS VARCHAR) END AS shown, CASE WHEN ms >= 1000 THEN concat((ms + 50) // 1000, '.', (ms + 50) // 100 % 10, 's') ELSE concat(ms, 'ms') END AS took FROM (SELECT *, input_tokens * output_tokens * event_id AS n, duration_ms * 5 AS ms FROM proxy)")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = proxy(spark, sf_dir)
    usd, i, o = F.col("estimated_cost"), F.col("input_tokens"), F.col("output_tokens")
    rates = {"USD": 1.0, "EUR": 0.9}
    return rounded(p.select("message_id", numbers.converted(usd, rates, F.lit("EUR")).alias("eur"), numbers.converted(usd, rates, F.lit("XYZ")).alias("xyz"), numbers.split_cost(usd, i, o)["input_cost"].alias("input_cost"), numbers.status_class(F.col("status_code")).alias("class"), numbers.short_number(i * o * F.col("event_id")).alias("shown"), numbers.short_duration(F.col("duration_ms") * 5).alias("took")))


# cumulative counters of each conversation, made from lengths; every fifth total is missing, and turn 7 begins anew
_TURNS = "SELECT conv_id, turn, role, text, length(text) AS n, CASE WHEN turn >= 7 THEN 1 ELSE 0 END AS part FROM conversations"


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"), F.when(F.col("turn") >= 7, 1).otherwise(0).alias("part"))
    run = Window.partitionBy("conv_id", "part").orderBy("turn")
    sums = {"input": F.sum("n").over(run), "output": F.sum(F.col("n") % 7).over(run), "cache_create": F.lit(0).cast("long"), "cache_read": F.sum(F.expr("n div 2")).over(run)}
    total = F.struct(*(c.alias(k) for k, c in sums.items()))
    last = F.struct(F.col("n").alias("input"), (F.col("n") % 7).alias("output"), F.lit(0).cast("long").alias("cache_create"), F.expr("n div 2").alias("cache_read"))
    return t.select("conv_id", "turn", total.alias("t"), last.alias("l")).select("conv_id", "turn", F.when(F.col("turn") % 5 != 4, F.col("t")).alias("total"), F.when(F.col("turn") % 5 != 0, F.col("l")).alias("last"))


@query(
    f"""WITH t AS ({_TURNS}), c AS (
  SELECT conv_id, turn, n, CASE WHEN turn % 5 <> 4 THEN sum(n) OVER w END AS ti, CASE WHEN turn % 5 <> 4 THEN sum(n % 7) OVER w END AS o, CASE WHEN turn % 5 <> 4 THEN sum(n // 2) OVER w END AS r, turn % 5 <> 0 AS has_last
  FROM t WINDOW w AS (PARTITION BY conv_id, part ORDER BY turn)
), b AS (
  SELECT *, last_value(ti IGNORE NULLS) OVER p AS bi, last_value(o IGNORE NULLS) OVER p AS bo, last_value(r IGNORE NULLS) OVER p AS br FROM c WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), d AS (
  SELECT *, CASE WHEN ti IS NULL THEN 'l' WHEN bi IS NULL OR ti < bi OR o < bo OR r < br THEN CASE WHEN has_last THEN 'l' ELSE 't' END ELSE 'd' END AS way FROM b
), x AS (
  SELECT conv_id, turn, CASE way WHEN 'l' THEN n WHEN 't' THEN ti ELSE ti - bi END AS i, CASE way WHEN 'l' THEN n % 7 WHEN 't' THEN o ELSE o - bo END AS o, CASE way WHEN 'l' THEN n // 2 WHEN 't' THEN r ELSE r - br END AS r FROM d
)
SELECT conv_id, turn, CAST(i - least(r, i) AS BIGINT) AS input, CAST(o AS BIGINT) AS output, CAST(least(r, i) AS BIGINT) AS cache_read FROM x"""
)
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences.counter_deltas(_counters(spark, sf_dir), "conv_id", ["turn"])
    return d.select("conv_id", "turn", "delta.input", "delta.output", "delta.cache_read")


@query(f"WITH t AS ({_TURNS}) SELECT conv_id, turn, coalesce(last_value(CASE WHEN turn % 3 = 1 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'unknown') AS role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS event_index FROM t")
def carried_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, F.col("role")).otherwise("").alias("role"))
    return sequences.numbered(sequences.carried(c, "role", "conv_id", ["turn"]), "conv_id", ["turn"])


@query("SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS topic, arg_max(text, turn) FILTER (role = 'user') AS last_prompt FROM conversations GROUP BY 1")
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.topic_and_last_prompt(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", F.col("role") == "user")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(count(*) AS BIGINT) AS copies FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_extendedprice FROM lineitem) GROUP BY ALL")
def largest_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_partkey")
    kept = sequences.keep_largest(li, ["l_orderkey", "l_linenumber"], "l_extendedprice", "l_shipdate", "l_partkey")
    return kept.join(li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_extendedprice", "copies")


_MESSAGES = "SELECT concat('m', event_id % 4000) AS message_id, concat('s', user_id) AS session_id, user_id % 3 AS source_rank, user_id * 10 AS last_modified, event_id FROM events"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("concat('m', CAST(event_id % 4000 AS STRING)) AS message_id", "concat('s', CAST(user_id AS STRING)) AS session_id", "user_id % 3 AS source_rank", "user_id * 10 AS last_modified", "event_id")


@query(f"WITH m AS ({_MESSAGES}) SELECT message_id, session_id, source_rank FROM m QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY source_rank, last_modified, session_id) = 1")
def first_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.first_owner(_messages(spark, sf_dir)).select("message_id", "session_id", "source_rank")


@query(f"WITH m AS ({_MESSAGES}) SELECT CASE WHEN n > 1 THEN session_id || ':' || message_id ELSE message_id END AS key, count(*) AS copies FROM (SELECT *, (SELECT count(DISTINCT session_id) FROM m x WHERE x.message_id = m.message_id) AS n FROM m) GROUP BY 1")
def message_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.message_keys(_messages(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("copies"))


@query(f"WITH m AS ({_MESSAGES}) SELECT message_id, count(DISTINCT session_id) AS sessions FROM m GROUP BY 1 HAVING count(DISTINCT session_id) > 1 ORDER BY 2 DESC, 1 LIMIT 100")
def id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.id_conflicts(_messages(spark, sf_dir))


@query(f"WITH m AS ({_MESSAGES}) SELECT message_id, session_id, event_id AS time_created FROM m LEFT JOIN (SELECT concat('s', c_custkey) AS session_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 50 END AS start FROM customer) USING (session_id) WHERE start IS NULL OR event_id >= start")
def without_fork_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir).select("message_id", "session_id", F.col("event_id").alias("time_created"))
    known = read(spark, sf_dir, "customer").selectExpr("concat('s', CAST(c_custkey AS STRING)) AS session_id", "CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 50 END AS time_created")
    return sequences.without_fork_replays(m, known).select("message_id", "session_id", "time_created")


@query(f"WITH m AS ({_MESSAGES}) SELECT message_id, session_id FROM m WHERE event_id % 4000 < 500")
def records_by_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a list of ids, wherever in the table they are."""
    ids = spark.range(500).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"))
    return with_messages(_messages(spark, sf_dir), ids).select("message_id", "session_id")


@query(f"WITH m AS ({_MESSAGES}) SELECT message_id, arg_max(session_id, struct_pack(t := source_rank, s := session_id)) AS session_id FROM m WHERE session_id <> 's7' GROUP BY 1")
def filled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sessions that a message was seen in, the last; some records name none, and many share a time."""
    seen = _messages(spark, sf_dir).select("message_id", F.when(F.col("session_id") == "s7", " ").otherwise(F.col("session_id")).alias("session_id"), F.col("source_rank").alias("timestamp"))
    return message_sessions(seen)


@query(BASE_CTE + "SELECT 'proxy' AS rows, count(*) AS n, max(timestamp) AS max_ts, max(event_id) AS max_version FROM proxy UNION ALL SELECT 'local', count(*), max(timestamp), max(event_id) FROM local")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (maintenance.signature(f(spark, sf_dir), "timestamp", "event_id").withColumn("rows", F.lit(n)) for n, f in (("proxy", proxy), ("local", local)))
    return a.unionByName(b).select("rows", "n", "max_ts", "max_version")


@query(BASE_CTE + "SELECT min(t) AS first, max(t) AS last FROM (SELECT timestamp // 1000 AS t FROM proxy UNION ALL SELECT timestamp FROM local UNION ALL SELECT timestamp FROM remote)")
def time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.time_bounds(proxy(spark, sf_dir).select(F.expr("timestamp div 1000")), local(spark, sf_dir).select("timestamp"), remote(spark, sf_dir).select("timestamp"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = local(spark, sf_dir).withColumn("source_file_id", F.col("event_id") % 40)
    files = spark.range(40).select(F.col("id").alias("source_file_id"), (F.col("id") % 4 != 1).alias("present"))
    return own, files


@query(BASE_CTE + f", o AS (SELECT * FROM local WHERE event_id % 40 % 4 = 1), kept AS (SELECT * FROM local WHERE NOT (event_id % 40 % 4 = 1 AND timestamp < {END})) SELECT (SELECT count(*) FROM local) AS total, (SELECT count(*) FROM o) AS orphans, (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM sessions WHERE session_id NOT IN (SELECT session_id FROM o WHERE timestamp < {END} AND session_id NOT IN (SELECT session_id FROM kept))) AS sessions")
def orphan_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, files = _stored(spark, sf_dir)
    known = sessions(spark, sf_dir)
    orphans = maintenance.orphan_facts(own, known, files)
    kept, left = maintenance.purged(own, known, orphans, "event_id", END)
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(own, "total").join(n(orphans, "orphans")).join(n(kept, "kept")).join(n(left, "sessions"))


@query(BASE_CTE + "SELECT dirty, source_file_present, sync_version, count(*) AS requests, CAST(sum(input_tokens + CASE WHEN dirty AND source_file_present THEN 1 ELSE 0 END) AS BIGINT) AS input_tokens FROM (SELECT input_tokens, user_id % 3 = 0 AS dirty, NOT (user_id % 3 = 0 AND event_id % 10 = 1) AS source_file_present, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END AS sync_version FROM (SELECT input_tokens, event_id, CAST(substr(session_id, 2) AS BIGINT) AS user_id FROM local)) GROUP BY ALL")
def synced_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some sessions parsed anew: their requests are replaced, those that they lack now are marked, all others are as they were."""
    stored = local(spark, sf_dir).select("event_id", "session_id", "input_tokens", F.lit(True).alias("source_file_present"), F.lit(1).alias("sync_version"))
    dirty = F.substring("session_id", 2, 20).cast("long") % 3 == 0
    parsed = stored.where(dirty & (F.col("event_id") % 10 != 1)).withColumn("input_tokens", F.col("input_tokens") + 1)
    after = maintenance.synced_facts(stored, parsed, stored.where(dirty).select("session_id"), "event_id")
    return after.groupBy(dirty.alias("dirty"), "source_file_present", "sync_version").agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_partkey % 7 = 0 THEN 'removed' ELSE 'dirty' END AS change FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 <> 0 OR p_partkey % 7 = 0 AND p_partkey % 5 <> 0 OR p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_size > 25")
def changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("f"))
    return maintenance.changed_keys(parts.where("k % 5 <> 0"), parts.where("k % 7 <> 0").withColumn("f", F.when(F.col("f") > 25, F.col("f") + 1).otherwise(F.col("f"))), "k", "f")


@query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.latest_versions(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("SELECT event_type AS field, arg_max(CAST(value AS VARCHAR), event_id) AS value, max(event_id) AS updated_at FROM (SELECT event_type, printf('%.2f', value) AS value, event_id FROM events) GROUP BY 1")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "events").select(F.col("event_type").alias("field"), F.format_string("%.2f", "value").alias("value"), F.col("event_id").alias("updated_at"), F.col("user_id").cast("string").alias("device_id"))
    return maintenance.merged_settings(v)


@query("SELECT user_id AS device_id, event_id AS seq FROM (SELECT *, min(CASE WHEN gap THEN event_id END) OVER (PARTITION BY user_id) AS first_gap FROM (SELECT user_id, n AS event_id, n - lag(n) OVER (PARTITION BY user_id ORDER BY n) <> 1 AS gap FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id > 5000 AND user_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM events))) WHERE first_gap IS NULL OR event_id < first_gap")
def applied_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) + F.when((F.col("event_id") > 5000) & (F.col("user_id") % 2 == 0), 1).otherwise(0)
    return maintenance.applied_batches(read(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), n.alias("seq")))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def newest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.newest(read(spark, sf_dir, "events").select("event_id", "ts"), 200, "ts", "event_id").select("event_id")


@query(BASE_CTE + f"SELECT count(*) AS n, count(*) FILTER (client_tool = 'codex') AS gone FROM proxy WHERE timestamp >= {START * 1000} AND coalesce(api_key_prefix <> 'sk-1', true)")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = maintenance.without(maintenance.retained(proxy(spark, sf_dir), START * 1000), F.col("api_key_prefix") == "sk-1")
    return kept.agg(F.count("*").alias("n"), F.count_if(F.col("client_tool") == "codex").alias("gone"))


@query("SELECT CASE WHEN c_name LIKE 'Customer#0000000%' THEN 'c-' || substr(c_name, 17) ELSE c_name END AS session_id FROM customer")
def renamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.renamed_sessions(read(spark, sf_dir, "customer").select(F.col("c_name").alias("session_id")), "Customer#0000000", "c-")


@query("SELECT event_id AS k, user_id AS v FROM events")
def seeded_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("user_id").alias("v"))
    return maintenance.seeded(ev.where("k % 3 = 0"), ev, "k")


_TREND = f", t AS (SELECT timestamp_sec // 3600 * 3600 AS b, CAST(sum(total_tokens) AS BIGINT) AS v, CAST(sum(request_count) AS BIGINT) AS r FROM facts WHERE timestamp_sec >= {START} AND timestamp_sec < {END} GROUP BY 1), tr AS (SELECT s.b, coalesce(v, 0) AS v, coalesce(r, 0) AS r FROM (SELECT unnest(generate_series(CAST({START} AS BIGINT), {END - 1}, 3600)) AS b) s LEFT JOIN t USING (b))"


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend(facts(spark, sf_dir).where(f"timestamp_sec >= {START} AND timestamp_sec < {END}"), START, END, 3600)


@query(BASE_CTE + _TREND + "SELECT b AS bucket_start, v AS total_tokens FROM tr ORDER BY v DESC, b LIMIT 1")
def peak_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.peak_point(_trend(spark, sf_dir))


@query(BASE_CTE + _TREND + "SELECT first_value, last_value, round(c, 4) AS change, CASE WHEN c > 5 THEN 'up' WHEN c < -5 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT *, CASE WHEN first_value = 0 THEN CASE WHEN last_value > 0 THEN 100.0 ELSE 0 END ELSE 100.0 * (last_value - first_value) / first_value END AS c FROM (SELECT arg_min(v, b) AS first_value, arg_max(v, b) AS last_value FROM tr))")
def trend_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(presentation.direction(_trend(spark, sf_dir)))


@query(BASE_CTE + _TREND + ", d AS (SELECT strftime(make_timestamp(b * 1000000), '%Y-%m-%d') AS day, CAST(sum(v) AS BIGINT) AS total_tokens FROM tr GROUP BY 1) SELECT day, total_tokens, CASE WHEN total_tokens <= 0 THEN 0 WHEN total_tokens / max(total_tokens) OVER () < 0.25 THEN 1 WHEN total_tokens / max(total_tokens) OVER () < 0.5 THEN 2 WHEN total_tokens / max(total_tokens) OVER () < 0.75 THEN 3 ELSE 4 END AS level, count(*) FILTER (total_tokens > 0) OVER () AS active_days FROM d")
def day_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.day_heat(_trend(spark, sf_dir))


@query(BASE_CTE + _TREND + "SELECT b AS bucket_start, round(v / max(v) OVER (), 4) AS total_tokens_share, round(r / max(r) OVER (), 4) AS requests_share FROM tr")
def normalised_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(presentation.normalised(_trend(spark, sf_dir), "total_tokens", "requests").select("bucket_start", "total_tokens_share", "requests_share"))


_M = f", m AS (SELECT model, {METRICS_SQL} FROM facts GROUP BY model)"


@query(BASE_CTE + _M + "SELECT model, total_tokens, round(greatest(4, 100.0 * total_tokens / max(total_tokens) OVER ()), 4) AS bar FROM m WHERE model <> 'unknown' ORDER BY total_tokens DESC, model LIMIT 5")
def leading_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(presentation.leaders(model_table(facts(spark, sf_dir))))


@query(BASE_CTE + _M + "SELECT model, CAST(row_number() OVER (ORDER BY requests DESC, cost DESC, total_tokens DESC, model) AS INTEGER) AS place FROM m")
def resorted_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.resorted(model_table(facts(spark, sf_dir)), "requests").select("model", "place")


@query(BASE_CTE + _M + "SELECT model, round(100.0 * total_tokens / (SELECT sum(total_tokens) FROM m), 4) AS percent FROM m ORDER BY 2 DESC, 1 LIMIT 6")
def shown_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(presentation.shown_models(model_table(facts(spark, sf_dir))).select("model", "percent"))
