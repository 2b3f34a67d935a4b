"""Streams and stored days."""

import json

from pyspark.sql import functions as F

from meterlake.functions.calendar import epoch
from meterlake.operators import maintenance as M
from meterlake.plans.commands import Context, Usage
from meterlake.plans.materialize import DayStore, can_use_summaries, day_dependencies, observations
from meterlake.queries import bindings as B
from meterlake.streaming.blocks import live_blocks
from meterlake.streaming.capture import EVENTS, captured, folded, hourly_windows, recent_largest, recent_unique
from meterlake.streaming.ingest import ChangeFeed, RecordStore

SF = "/root/testdata/sf0.001"


def events(spark):
    def e(request, seq, **data):
        return request, seq, 1000 + seq * 100, json.dumps(data)

    return spark.createDataFrame(
        [
            e("a", 0, type="message_start", message={"id": "m1", "model": "x", "usage": {"input_tokens": 10, "cache_read_input_tokens": 4, "output_tokens": 1}}),
            e("a", 1, type="content_block_delta"),
            e("a", 2, type="message_delta", usage={"output_tokens": 20}),
            e("b", 0, id="c1", model="g", choices=[{"delta": {"content": "hi"}}], usage=None),
            e("b", 1, id="c1", choices=[], usage={"prompt_tokens": 30, "completion_tokens": 6, "prompt_tokens_details": {"cached_tokens": 10}}),
            e("c", 0, modelVersion="gm", candidates=[{"content": {"parts": [{"text": "x"}]}}], usageMetadata={"promptTokenCount": 5, "candidatesTokenCount": 2, "thoughtsTokenCount": 3}),
        ],
        EVENTS,
    )


def test_dialects(spark):
    got = {r.request_id: (r.message_id, r.model, r.input_tokens, r.output_tokens, r.cache_read_tokens, r.ttft_ms) for r in folded(events(spark)).collect()}
    assert got == {"a": ("m1", "x", 10, 20, 4, 100), "b": ("c1", "g", 20, 6, 10, 0), "c": (None, "gm", 5, 5, 0, 0)}


def run(stream, name, mode="update"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_streams(spark, tmp_path):
    events(spark).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))
    # nothing has come behind them: no request is known to be over
    assert run(captured(source), "captured", "append").count() == 0
    late = events(spark).withColumn("ts_ms", F.col("ts_ms") + 86_398_900)  # the first event before midnight, the others after it
    late.unionByName(spark.createDataFrame([("end", 0, 3 * 86_400_000, "{}")], EVENTS)).write.json(str(tmp_path / "night"))
    night = spark.readStream.schema(EVENTS).json(str(tmp_path / "night"))
    got = {r.request_id: (r.input_tokens, r.output_tokens) for r in run(captured(night), "night", "append").collect()}
    assert got == {"a": (10, 20), "b": (20, 6), "c": (5, 5)}
    records = spark.readStream.schema("storage_dedupe_key string, timestamp long, output_tokens long")
    spark.createDataFrame([("k", 1000, 1), ("k", 2000, 1), ("l", 3_700_000, 5)], "storage_dedupe_key string, timestamp long, output_tokens long").write.json(str(tmp_path / "rec"))
    unique = recent_unique(records.json(str(tmp_path / "rec")).withColumn("event_time", F.timestamp_millis("timestamp")))
    assert run(unique, "uniq", "append").count() == 2
    assert {r.requests for r in run(hourly_windows(records.json(str(tmp_path / "rec"))), "hours").collect()} == {1, 2}


def test_live_blocks(spark, tmp_path):
    rows = [("s", 0, 10), ("s", 3600, 5), ("s", 6 * 3600, 7), ("t", 50, 1)]
    spark.createDataFrame(rows, "session_id string, timestamp_sec long, total_tokens long").coalesce(1).write.json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("session_id string, timestamp_sec long, total_tokens long").json(str(tmp_path / "in"))
    try:
        got = {r.session_id: (r.start_epoch, r.used_tokens) for r in run(live_blocks(stream), "blocks").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {"s": (6 * 3600, 7), "t": (50, 1)}


B_DAY = epoch(2024, 1, 5)
RECORD = "storage_dedupe_key string, timestamp long, input_tokens long, output_tokens long, cache_create_tokens long, cache_read_tokens long"


def test_record_store(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "r"))
    touched = []
    store.upsert(spark.createDataFrame([("a", 1000, 5, 0, 0, 0), ("b", 86_400_000, 5, 0, 0, 0)], RECORD), 0, touched.extend)
    store.upsert(spark.createDataFrame([("a", 1500, 9, 0, 0, 0), ("b", 86_400_001, 1, 0, 0, 0)], RECORD), 1, touched.extend)
    assert {r.storage_dedupe_key: r.input_tokens for r in store.read().collect()} == {"a": 9, "b": 5}
    assert touched == ["1970-01-01", "1970-01-02"] * 2


def test_records_replace_their_key_across_days(spark, tmp_path):
    """A larger record after midnight replaces the one before it, whose day may be empty then; a smaller one changes nothing."""
    store, days = RecordStore(spark, str(tmp_path / "r")), DayStore(spark, str(tmp_path / "d"))
    days._put(spark.createDataFrame([(d, "x", 1, days.mode) for d in ("1970-01-01", "1970-01-02", "1970-01-04")], "local_date string, fingerprint string, version long, mode string"))
    touched = []

    def on_days(found):
        touched.append(found)
        days.invalidate(found, "1970-01-05")

    one = lambda *rows: spark.createDataFrame(list(rows), RECORD)
    for i, batch in enumerate([one(("k", 86_399_000, 5, 0, 0, 0)), one(("k", 86_401_000, 9, 0, 0, 0), ("l", 1, 1, 0, 0, 0)), one(("k", 10, 1, 0, 0, 0)), one(("k", 86_401_000, 9, 0, 0, 0)), one(("l", 3 * 86_400_000, 2, 0, 0, 0))]):
        for _ in range(2):  # a repeated batch changes nothing
            store.upsert(batch, i, on_days)
    assert sorted((r.storage_dedupe_key, r.input_tokens, r.day) for r in store.read().collect()) == [("k", 9, "1970-01-02"), ("l", 2, "1970-01-04")]
    assert len(list((tmp_path / "r/runs").iterdir())) == 5, "a run for each batch, however often it comes"
    assert ["1970-01-01", "1970-01-02"] in touched and touched[-1][-1] == "1970-01-04"
    assert {r.fingerprint for r in days.state().collect()} == {""}


def test_runs_are_merged(spark, tmp_path):
    """What is read is the same however runs are merged; a batch writes its own rows alone, and a late repeat changes nothing."""
    store, days = RecordStore(spark, str(tmp_path / "r"), fanout=2), []
    put = lambda i, source, *rows: store.upsert(spark.createDataFrame(list(rows), f"{RECORD}, extra int" if len(rows[0]) > 6 else RECORD), i, days.extend, source)
    got = lambda: sorted((r.storage_dedupe_key, r.input_tokens, r.timestamp) for r in store.read().collect())
    put(0, "a", ("k", 1000, 5, 0, 0, 0), ("l", 1, 1, 0, 0, 0))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "r/runs").rglob("*.parquet")}
    put(0, "b", ("k", 2000, 5, 0, 0, 0))
    assert store.runs() == [(1, 2)] and before and got() == [("k", 5, 2000), ("l", 1, 1)]
    put(1, "a", ("k", 3000, 4, 0, 0, 0, 7))
    assert store.runs() == [(1, 2), (3, 3)] and "extra" in store.read().columns
    for _ in range(2):
        put(0, "b", ("k", 2000, 5, 0, 0, 0))  # again, after its run has been merged
        assert got() == [("k", 5, 2000), ("l", 1, 1)] and store.runs() == [(1, 2), (3, 3)]
    put(1, "b", ("m", 86_400_000, 1, 0, 0, 0))
    assert store.runs() == [(1, 4)] and [p.name for p in (tmp_path / "r/runs").iterdir()] == ["run=000000000001-000000000004"]
    assert got() == [("k", 5, 2000), ("l", 1, 1), ("m", 1, 86_400_000)] and set(days) == {"1970-01-01", "1970-01-02"}


def test_a_larger_record_replaces_one_on_the_stream(spark, tmp_path):
    rows = [("k", 1000, 5, 0, 0, 0), ("k", 2000, 9, 0, 0, 0), ("k", 3000, 1, 0, 0, 0), ("l", 1, 1, 0, 0, 0)]
    spark.createDataFrame(rows, RECORD).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(RECORD).json(str(tmp_path / "in")).withColumn("event_time", F.timestamp_millis("timestamp"))
    assert {r.storage_dedupe_key: r.input_tokens for r in run(recent_largest(stream), "largest").collect()} == {"k": 9, "l": 1}


def test_a_larger_record_of_the_next_day_replaces_one(spark, tmp_path):
    schema = f"{RECORD}, note string"
    batches = [[("k", 86_399_000, 5, 0, 0, 0, "first"), ("l", 1000, 1, 0, 0, 0, None)], [("k", 86_401_000, 9, 0, 0, 0, "larger")], [("k", 86_402_000, 2, None, 0, 0, "smaller")], [("z", 9 * 86_400_000, 1, 0, 0, 0, "much later")], [("k", 9 * 86_400_000, 1, 0, 0, 0, "anew")]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("event_time", F.timestamp_millis("timestamp"))
    shown = []

    def take(batch, _):
        shown.append(sorted(r.note or "" for r in batch.collect()))

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        recent_largest(stream).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert [x for x in shown if x] == [["", "first"], ["larger"], ["much later"], ["anew"]]


def test_change_feed(spark, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path / "feed"), "key string, v long", ["key"], snapshot_every=2, keep=1)
    put = lambda seq, *rows: feed.publish(spark.createDataFrame(list(rows), "key string, v long"), seq)
    got = lambda after=0: sorted((r.key, r.v) for r in feed.apply(after).collect())
    assert got() == [] and feed.cursor() == 0
    put(1, ("k", 10), ("only", 1))
    assert got() == [("k", 10), ("only", 1)]
    put(2, ("k", 20))
    put(4, ("k", 40))
    # the run ends before the batch that is missing; the snapshot holds what came before
    assert feed.snapshot() == 2 and feed.cursor() == 2 and got() == [("k", 20), ("only", 1)] and got(2) == []
    put(3, ("n", 3))
    assert feed.snapshot() == 4 and feed.cursor(1) == 4
    # a reader that lags behind the snapshot starts over from it, though its batches are gone
    assert got(1) == got(3) == [("k", 40), ("n", 3), ("only", 1)]
    assert sorted(x.name for x in (tmp_path / "feed/batches").iterdir()) == ["seq=000000000003", "seq=000000000004"]
    assert [x.name for x in (tmp_path / "feed/snapshots").iterdir()] == ["seq=000000000004"]
    put(5, ("k", 50), ("k5", 5))
    put(5, ("k", 51))
    assert got(4) == [("k", 51)]


def test_outbox(spark):
    box = spark.createDataFrame([], "event_id string, payload string, queued_at long, batched_seq long, uploaded_at long")
    box = M.enqueued(box, spark.createDataFrame([("a", "1"), ("b", "1")], "event_id string, payload string"), 10)
    box = M.enqueued(box, spark.createDataFrame([("c", "1")], "event_id string, payload string"), 20)
    state = lambda d: {r.event_id: (r.payload, r.batched_seq, r.uploaded_at) for r in d.collect()}
    box = M.reserved(box, 1, 2)
    assert state(box) == {"a": ("1", 1, None), "b": ("1", 1, None), "c": ("1", None, None)}
    assert state(M.reserved(box, 2, 9))["c"] == ("1", 2, None) and state(M.reserved(box, 2, 9))["a"] == ("1", 1, None)
    assert state(M.released(box, 1))["a"] == ("1", None, None)
    sent = M.marked_uploaded(box, 1, 30)
    assert state(sent)["b"] == ("1", 1, 30) and state(M.released(sent, 1))["b"] == ("1", 1, 30)
    again = M.enqueued(sent, spark.createDataFrame([("a", "2")], "event_id string, payload string"), 40)
    assert state(again)["a"] == ("2", None, None)
    assert set(state(M.without_uploaded(again, 31))) == {"a", "c"}


def test_dirty_sessions_are_upserted(spark):
    schema = "dedupe_key string, session_id string, timestamp long, v int, source_file_present boolean, sync_version long"
    stored = spark.createDataFrame([("a", "s", 0, 1, True, 1), ("b", "s", 86_400, 1, True, 1), ("c", "t", 0, 1, True, 4), ("d", "u", 5, 1, True, 2)], schema)
    parsed = spark.createDataFrame([("a", "s", 0, 2), ("n", "s", 9, 1), ("d", "s", 5, 3)], "dedupe_key string, session_id string, timestamp long, v int")
    dirty = spark.createDataFrame([("s",)], "session_id string")
    after = M.synced_facts(stored, parsed, dirty)
    assert sorted(map(tuple, after.collect())) == [("a", "s", 0, 2, True, 2), ("b", "s", 86_400, 1, False, 2), ("c", "t", 0, 1, True, 4), ("d", "s", 5, 3, True, 1), ("n", "s", 9, 1, True, 1)]
    days = M.touched_days(stored, after, F.timestamp_seconds("timestamp").cast("date").cast("string"))
    assert sorted(r.day for r in days.collect()) == ["1970-01-01", "1970-01-02"]


def test_day_store(spark, tmp_path):
    p, mine, other, known, prices = B.proxy(spark, SF), B.local(spark, SF), B.remote(spark, SF), B.sessions(spark, SF), B.prices(spark)
    c = Context(epoch(2024, 1, 20, 12), sources=tuple(B.SOURCES))
    store, today = DayStore(spark, str(tmp_path / "days")), "2024-01-20"
    usage = Usage(p, mine, known, prices, other, store)
    f = B.facts(spark, SF)
    deps = day_dependencies(p, mine, other, sessions=known, prices=prices)
    assert store.stale(deps, today).count() == deps.where("local_date < '2024-01-20'").count() > 0
    assert len(usage.refresh_store(c)) == 19 and usage.refresh_store(c) == [] and store.stale(deps, today).count() == 0
    both = store.facts(f, today)
    total = lambda d: tuple(d.agg(F.count("*"), F.sum("total_tokens"), F.sum(F.xxhash64("canonical_request_key", "status_code").cast("decimal(38,0)"))).first())
    assert total(both) == total(f)
    assert store.facts(f, today, "2024-01-18").where("local_date < '2024-01-18'").count() == 0
    # any value that changes makes its day stale: a model, a status, a session's folder; a price makes all
    day = lambda **kw: sorted(r.local_date for r in store.stale(day_dependencies(kw.get("p", p), kw.get("l", mine), other, sessions=kw.get("s", known), prices=kw.get("r", prices)), today).collect())
    first = p.orderBy("timestamp").first()
    assert day(p=p.withColumn("status_code", F.when(F.col("event_id") == first.event_id, 418).otherwise(F.col("status_code")))) == ["2024-01-01"]
    assert day(p=p.withColumn("model", F.when(F.col("event_id") == first.event_id, "other").otherwise(F.col("model")))) == ["2024-01-01"]
    once = spark.createDataFrame([("lone",)], "session_id string")
    rare = lambda d, u: d.withColumn("session_id", F.when(F.col("timestamp").between(B_DAY * u, (B_DAY + 86_399) * u), "lone").otherwise(F.col("session_id")))
    with_meta = [day_dependencies(rare(p, 1000), rare(mine, 1), other, sessions=once.withColumn("cwd", F.lit(x))) for x in ("/here", "/moved")]
    assert [r.local_date for r in with_meta[0].exceptAll(with_meta[1]).collect()] == ["2024-01-05"]
    assert len(day(r=prices.withColumn("input_price", F.col("input_price") + 1))) == 19
    # a day whose rows have all gone is forgotten
    late = Usage(*(x.where(F.col("timestamp") >= epoch(2024, 1, 3) * u) for x, u in ((p, 1000), (mine, 1))), known, prices, other.where(F.col("timestamp") >= epoch(2024, 1, 3)), store)
    assert {"2024-01-01", "2024-01-02"} <= set(late.refresh_store(c)) and store.read("facts").where("local_date < '2024-01-03'").count() == 0
    assert usage.refresh_store(c)[:2] == ["2024-01-01", "2024-01-02"]
    store.invalidate(["2024-01-03", today], today)
    assert day() == ["2024-01-03"] and total(store.facts(f, today)) == total(f)
    store.vacuum()
    assert total(store.facts(f, today)) == total(f)
    # another boundary: nothing that is stored counts
    assert DayStore(spark, store.path, boundary=4).state().count() == 0
    assert len(store.rebuild(usage.merged, deps, observations(p, mine, other), today)) == 19 and total(store.facts(f, today)) == total(f)
    assert [can_use_summaries(86_400, None, None), can_use_summaries(3600, None, None), can_use_summaries(86_400, "codex", None)] == [True, False, False]


def test_reports_from_stored_days(spark, tmp_path):
    """What a store answers is what facts answer."""
    args = B.proxy(spark, SF), B.local(spark, SF), B.sessions(spark, SF), B.prices(spark), B.remote(spark, SF)
    plain, stored = Usage(*args), Usage(*args, DayStore(spark, str(tmp_path / "days")))
    c = Context(B.AS_OF, sources=tuple(B.SOURCES))
    stored.refresh_store(c)
    shown = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.collect())
    for some in (c, Context(B.AS_OF, include_errors=False)):
        a, b = (u.statistics_summary(some, B.START, B.END, 86_400) for u in (plain, stored))
        assert all(shown(a[k]) == shown(b[k]) for k in a)
        a, b = (u.refresh_bundle(some) for u in (plain, stored))
        assert shown(a["windows"]) == shown(b["windows"]) and shown(a["window_models"]) == shown(b["window_models"])
    assert stored.daily_models(c).where("size(status_counts) > 1").count() > 0


def test_commands(spark):
    usage = Usage(B.proxy(spark, SF), B.local(spark, SF), B.sessions(spark, SF), B.prices(spark), B.remote(spark, SF))
    c = Context(B.AS_OF, sources=tuple(B.SOURCES))
    summary = usage.statistics_summary(c, B.START, B.END)
    total = summary["totals"].first()
    assert total.total_tokens == summary["models"].agg(F.sum("total_tokens")).first()[0] == summary["trend"].agg(F.sum("total_tokens")).first()[0] > 0
    assert usage.refresh_bundle(c)["windows"].count() == 6
    assert set(usage.overview_breakdown(c, "30d", B.sources(spark))) == {"source", "tool", "model"}
    assert usage.recent_requests(c, 500).count() == 30 and usage.all_sessions(c, 5).count() == 5
    only = Context(B.AS_OF, source="src-a", sources=tuple(B.SOURCES))
    assert 0 < usage.facts(only).count() < usage.facts(c).count()
    page, n = usage.search_prices("err")
    assert page.count() == n.first().total == 2


def test_a_dropped_device_leaves_its_days_out_of_date(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    from meterlake.operators.maintenance import devices
    from meterlake.plans.commands import Context, Usage
    from meterlake.schemas import LOCAL, PRICES, PROXY, SESSIONS

    none = lambda schema: spark.createDataFrame([], schema)
    mine = [{"session_id": "s", "tool": "t", "message_id": str(i), "timestamp": B_DAY + i * 86_400, "model": "m", "input_tokens": 1, "output_tokens": 1, "cache_create_tokens": 0, "cache_read_tokens": 0, "total_tokens": 2, "request_count": 1, "device_id": d} for i, d in enumerate(("a", "b", "a"))]
    remote = spark.createDataFrame(mine, StructType([*LOCAL.fields, StructField("device_id", StringType())]))
    usage, c = Usage(none(PROXY), none(LOCAL), none(SESSIONS), none(PRICES), remote, DayStore(spark, str(tmp_path / "d"))), Context(B_DAY + 5 * 86_400)
    assert {r.device_id: r.facts for r in devices(remote).collect()} == {"a": 2, "b": 1}
    assert usage.refresh_store(c) == ["2024-01-05", "2024-01-06", "2024-01-07"]
    assert [r.timestamp_sec for r in usage.timeline(c).collect()] == [B_DAY, B_DAY + 86_400, B_DAY + 2 * 86_400]
    assert usage.drop_device(c, "a") == ["2024-01-05", "2024-01-07"]
    assert usage.refresh_store(c) == ["2024-01-05", "2024-01-07"]
    assert [r.timestamp_sec for r in usage.timeline(c).collect()] == [B_DAY + 86_400]
    assert usage.drop_device(c, None) == ["2024-01-06"]
    assert usage.session_of_message("1").count() == 0


def test_requests_seen_on_two_days(spark, tmp_path):
    """A transcript row that comes late, or goes, moves its request between days: stored days are what one merge gives."""
    from meterlake.schemas import LOCAL, PRICES, PROXY, SESSIONS

    table = lambda rows, schema: spark.createDataFrame([dict.fromkeys(schema.names) | r for r in rows], schema)
    counts = {"input_tokens": 5, "output_tokens": 5, "cache_create_tokens": 0, "cache_read_tokens": 0}
    seen = lambda at, key=None, m="1", session="s": {"timestamp": at * 1000, "message_id": m, "canonical_request_key": key, "client_tool": "t", "session_id": session, "model": "m", "status_code": 200, "estimated_cost": 0.0, "cost_locked": True} | counts
    told = lambda at, key=None, m="1", session="s": {"timestamp": at, "message_id": m, "request_key": key, "tool": "t", "session_id": session, "model": "m", "total_tokens": 10, "request_count": 1} | counts
    before, after, now = B_DAY + 86_399, B_DAY + 86_401, B_DAY + 6 * 86_400
    far, late, fill = told(B_DAY + 4 * 86_400, "far", "9"), told(after), told(after, m="3", session="known")
    today = told(now, m="2")
    p = [seen(before), seen(B_DAY, "far", "8"), seen(B_DAY + 5 * 86_400 + 86_399, m="2"), seen(B_DAY + 2 * 86_400, "own", "3", "")]
    steps = [
        (p, []),
        (p, [late, far]),  # requests move from one finished day to the next, or four days on
        (p[1:], [late, today]),  # a record goes, and a transcript row; yesterday's request moves to the live day
        (p, [today, fill]),  # a message of one day names the session of a record of another
        ([], []),
    ]
    store, c = DayStore(spark, str(tmp_path / "d")), Context(now + 3600)
    shown = lambda d: sorted(tuple(r) for r in d.select("canonical_request_key", "session_id", "timestamp_sec", "coverage_origin").collect())
    empty = lambda s: spark.createDataFrame([], s)
    for theirs, mine in steps:
        args = table(theirs, PROXY), table(mine, LOCAL), empty(SESSIONS), empty(PRICES), empty(LOCAL)
        stored = Usage(*args, store)
        stored.refresh_store(c)
        assert shown(stored.facts(c)) == shown(Usage(*args).facts(c)), (theirs, mine)
    assert stored.refresh_store(c) == []
    # the live day, once it is over, is built though nothing of it has changed
    args = table(p, PROXY), table([today], LOCAL), empty(SESSIONS), empty(PRICES), empty(LOCAL)
    stored = Usage(*args, store)
    stored.refresh_store(c)
    assert "2024-01-11" in stored.refresh_store(Context(now + 90_000))
    assert shown(stored.facts(Context(now + 90_000))) == shown(Usage(*args).facts(c))
