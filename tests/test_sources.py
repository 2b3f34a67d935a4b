"""Readers on files like those that tools write."""

import json
import random
import sqlite3

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from meterlake.sources import catalogues, files, transcripts


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n" + " " * 120)


def usage(**kw):
    return {"input_tokens": 10, "output_tokens": 5, "cache_creation_input_tokens": 1, "cache_read_input_tokens": 2} | kw


def test_assistant_lines(spark, tmp_path):
    def line(i, n, **kw):
        return {"type": "assistant", "timestamp": f"2026-01-01T00:00:0{n}Z", "message": {"id": i, "model": "m", "usage": usage(**kw)}}

    write(tmp_path / "p/s1.jsonl", {"type": "user"}, line("a", 1, output_tokens=3), line("a", 2, output_tokens=9), line("b", 3), "not json", {"type": "assistant", "uuid": "c", "timestamp": 1767225600, "deep": [{"x": {"prompt_tokens": 7, "completion_tokens": 1}}]})
    write(tmp_path / "p/s1/subagents/agent.jsonl", line("d", 4))
    (tmp_path / "p/tiny.jsonl").write_text("{}")
    got = {r.message_id: r for r in transcripts.assistant_lines(spark, str(tmp_path)).collect()}
    assert {k: (r.session_id, r.total_tokens) for k, r in got.items()} == {"a": ("s1", 22), "b": ("s1", 18), "c": ("s1", 8), "d": ("s1", 18)}
    assert got["b"].timestamp == 1767225603 and got["c"].timestamp == 1767225600


def test_rollout_lines(spark, tmp_path):
    def count(ts, total, last=None):
        keys = ("input_tokens", "cached_input_tokens", "output_tokens")
        info = {"total_token_usage": dict(zip(keys, total, strict=True))} | ({"last_token_usage": dict(zip(keys, last, strict=True))} if last else {})
        return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": info}}

    write(
        tmp_path / "rollout-1.jsonl",
        {"timestamp": "2027-03-09T11:20:00Z", "type": "session_meta", "payload": {"id": "night-run"}},
        {"timestamp": "2027-03-09T11:20:07Z", "type": "turn_context", "payload": {"model": "acme/orbit-2.1-2027-11-30"}},
        count("2027-03-09T11:21:13Z", (210, 70, 12)),
        count("2027-03-09T11:24:40Z", (333, 99, 47)),
        count("2027-03-09T11:24:41Z", (333, 99, 47)),
    )
    got = transcripts.rollout_lines(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r.input_tokens, r.cache_read_tokens, r.output_tokens, r.total_tokens, r.model, r.session_id) for r in got] == [(140, 70, 12, 222, "orbit-2.1", "night-run"), (94, 29, 35, 158, "orbit-2.1", "night-run")]
    assert [r.message_id for r in got] == ["codex:night-run:0", "codex:night-run:1"]


def test_fork_replays_move_the_baseline_only(spark, tmp_path):
    event = lambda t, n: {"timestamp": f"2026-01-01T00:00:{t:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "output_tokens": 0}}}}
    write(tmp_path / "fork.jsonl", {"timestamp": "2026-01-01T00:00:10Z", "type": "session_meta", "payload": {"id": "f", "forked_from_id": "s"}}, event(5, 100), event(6, 150), event(20, 180))
    assert [r.input_tokens for r in transcripts.rollout_lines(spark, str(tmp_path)).collect()] == [30]


def test_chat_and_message_documents(spark, tmp_path):
    chat = {"sessionId": "c", "messages": [{"id": "1", "timestamp": "2026-01-01T00:00:00Z", "model": "models/G-2", "tokens": {"input": 50, "cached": 20, "output": 5, "thoughts": 3, "tool": 1}}, {"id": "2", "type": "user"}]}
    write(tmp_path / "chat/c.json", chat)
    r = transcripts.chat_documents(spark, str(tmp_path / "chat")).first()
    assert (r.session_id, r.model, r.input_tokens, r.cache_read_tokens, r.output_tokens) == ("c", "g-2", 30, 20, 9)
    write(tmp_path / "msg/m1.json", {"id": "m1", "sessionID": "o", "role": "assistant", "modelID": "x", "time": {"created": 1767225600000}, "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4, "write": 5}}})
    files_rows = transcripts.message_documents(spark, str(tmp_path / "msg"))
    assert files_rows.first().total_tokens == 15 and files_rows.first().timestamp == 1767225600
    database = files_rows.withColumn("total_tokens", F.lit(99).cast("long"))
    assert [r.total_tokens for r in transcripts.database_over_files(database, files_rows).collect()] == [99]


def test_shutdown_totals_are_spread(spark, tmp_path):
    metric = {"requests": {"count": 3}, "usage": {"inputTokens": 10, "outputTokens": 7, "cacheReadTokens": 4, "cacheWriteTokens": 0}}
    write(tmp_path / "a.jsonl", {"sessionId": "a", "timestamp": 1000, "type": "session.start"}, {"sessionId": "a", "timestamp": 1100, "type": "assistant.message", "data": {"outputTokens": 1}}, {"sessionId": "a", "timestamp": 1200, "type": "session.shutdown", "data": {"modelMetrics": {"m": metric}}})
    write(tmp_path / "b.jsonl", {"sessionId": "b", "timestamp": 1000, "type": "assistant.message", "data": {"messageId": "x", "model": "m", "outputTokens": 8}})
    got = transcripts.shutdown_totals(spark, str(tmp_path)).orderBy("session_id", "timestamp").collect()
    assert [(r.session_id, r.timestamp, r.input_tokens, r.output_tokens, r.cache_read_tokens) for r in got] == [("a", 1000, 2, 3, 2), ("a", 1100, 2, 2, 1), ("a", 1200, 2, 2, 1), ("b", 1000, 0, 8, 0)]


def test_agent_and_log_lines(spark, tmp_path):
    write(tmp_path / "agent/s.jsonl.archived", {"type": "model_change", "modelId": "big"}, {"timestamp": 1000, "message": {"role": "assistant", "usage": {"input": 10, "output": 2, "cacheRead": 4, "cacheWrite": 1}}})
    r = transcripts.agent_lines(spark, str(tmp_path / "agent")).first()
    assert (r.model, r.input_tokens, r.cache_read_tokens, r.total_tokens) == ("big", 6, 4, 13)
    write(tmp_path / "log/w.log", "noise", '[2026-01-01T00:00:00Z] info stream_event: {"type":"message_delta","usage":{"input_tokens":3,"output_tokens":4}} end', '[2026-01-01T00:00:01Z] stream_event {"type":"message_start"}')
    got = transcripts.log_lines(spark, str(tmp_path / "log")).collect()
    assert [(r.session_id, r.timestamp, r.total_tokens) for r in got] == [("w", 1767225600, 7)]


def test_sessions_and_sidecars(spark, tmp_path):
    write(tmp_path / "s1.jsonl", {"role": "assistant"}, {"role": "user"}, {"role": "assistant"})
    write(tmp_path / "s2.jsonl", {"role": "assistant"})
    write(tmp_path / "s2.telemetry.json", {"inputTokens": 5, "requests": 4, "cost": "0.5"})
    write(tmp_path / "s2.meta.json", {"workspace": "/w", "inputTokens": 9})
    got = {r.session_id: (r.request_count, r.input_tokens, r.estimated_cost, r.cwd) for r in transcripts.transcript_sessions(spark, str(tmp_path)).collect()}
    assert got == {"s1": (2, 0, None, None), "s2": (4, 5, 0.5, "/w")}
    votes = spark.createDataFrame([("s", "/a/b/c/d/x.py"), ("s", "/a/b/c/d/y.py"), ("s", "/a/b/c/e/z.py")], "session_id string, path string")
    assert transcripts.workspace_vote(votes).first().workspace == "/a/b/c"


def test_sessions_of_project_folders(spark, tmp_path):
    base = tmp_path / "projects"
    for folder in ("-home-u-shop", "-w-a-b"):
        (base / folder / "x" / "subagents").mkdir(parents=True)
    pad = {"pad": "x" * 200}
    write(base / "-home-u-shop/x.jsonl", {"type": "user", "timestamp": 1700000005, **pad}, {"type": "assistant", "timestamp": 1700000007})
    write(base / "-home-u-shop/x/subagents/y.jsonl", {"type": "assistant", "timestamp": 1700000009, **pad})
    write(base / "-w-a-b/z.jsonl", {"type": "assistant", "timestamp": 1700000001, "cwd": "/w/a-b", **pad}, {"type": "assistant", "cwd": "/elsewhere"})
    got = {r.session_id: (r.project_name, r.cwd, r.request_count, r.start_time, r.end_time) for r in transcripts.folder_sessions(spark, str(base)).collect()}
    assert got == {"x": ("shop", None, 2, 1700000005, 1700000009), "z": ("a-b", "/w/a-b", 2, 1700000001, 1700000001)}


def test_foreign_tables(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE sessions (id TEXT, model TEXT, started_at INTEGER, ended_at INTEGER, message_count INTEGER, input_tokens INTEGER, output_tokens INTEGER, cache_read_tokens INTEGER, cache_write_tokens INTEGER, estimated_cost_usd REAL, actual_cost_usd REAL)")
        db.executemany("INSERT INTO sessions VALUES (?, 'm', 1, 2, ?, 10, 5, 1, 0, 0.5, NULL)", [("a", 7), ("b", 0)])
    schema = "id string, model string, started_at long, ended_at long, message_count long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, estimated_cost_usd double, actual_cost_usd double"
    rows = catalogues.read_sqlite(spark, str(tmp_path / "x.db"), "sessions", schema, partitions=2)
    got = {r.session_id: (r.request_count, r.total_tokens, r.explicit_estimated_cost) for r in transcripts.session_totals(rows).collect()}
    assert got == {"a": (7, 16, 0.5), "b": (1, 16, 0.5)}
    sessions = spark.createDataFrame([("s",)], "session_id string")
    messages = spark.createDataFrame([("m", "s", "assistant", 1767225600000, '{"promptTokens": 9, "cachedTokens": 4, "completionTokens": 2}', '{"model": "q"}'), ("n", "gone", "assistant", 1, "{}", "{}")], "id string, session_id string, role string, created long, token_info string, model_info string")
    r = transcripts.editor_messages(sessions, messages).collect()
    assert [(x.message_id, x.model, x.input_tokens, x.timestamp) for x in r] == [("m", "q", 5, 1767225600)]
    assert [catalogues.schema_mode(c) for c in (["id", "session_id", "time_created", "time_updated", "data"], ["id", "session_id", "data"], ["id"])] == ["full", "message_only", "incompatible"]


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_lines_by_split(spark, tmp_path, split):
    rng = random.Random(split)
    texts = {f"{k}.log": "".join(rng.choice(["", "", " ", "x", "wanted é", "y" * 90]) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(60)) + rng.choice(["", "wanted"]) for k in range(4)}
    texts |= {"blank.log": "\n" * 40 + "wanted\n", "empty.log": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = sorted((name, i, line) for name, text in texts.items() for i, line in enumerate(text.replace("\r\n", "\n").split("\n")) if line.strip(" "))
    name = F.regexp_extract("path", "[^/]+$", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = files.numbered_lines(spark, str(tmp_path), "*.log", 1)
        assert sorted(map(tuple, got.select(name, "line_no", "line").collect())) == want
        some = files.numbered_lines(spark, str(tmp_path), "*.log", 1, F.col("line").contains("wanted"))
        assert sorted(map(tuple, some.select(name, "line_no", "line").collect())) == [w for w in want if "wanted" in w[2]]
        placed = files.lines(spark, str(tmp_path), "*.log", 1)
        assert placed.rdd.getNumPartitions() > 1 or split > 64
        in_order = [tuple(r) for r in placed.select(name.alias("name"), "place", "line").orderBy("name", "place").select("name", "line").collect()]
        assert in_order == [(n, line) for n, _, line in want]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_growing_table_as_a_stream(spark, tmp_path):
    """Rows that arrive during a read come with the next, and a read that failed comes again as it was."""
    file, batches, state = tmp_path / "g.db", [], {"fail": False, "arriving": []}

    def put(*rows):
        with sqlite3.connect(file) as db:
            db.executemany("INSERT INTO m VALUES (?, ?)", rows)

    with sqlite3.connect(file) as db:
        db.execute("CREATE TABLE m (id TEXT, t INTEGER)")

    def take(rows, number):
        put(*state["arriving"])
        state["arriving"] = []
        if state["fail"]:
            raise RuntimeError("lost")
        batches.append((rows.rdd.getNumPartitions(), sorted((r.t or 0, r.id or "") for r in rows.collect())))

    def run(arriving=(), fail=False):
        state.update(fail=fail, arriving=list(arriving))
        batches.clear()
        stream = catalogues.stream_sqlite(spark, str(file), "m", "id string, t long", "t", "id", rows_per_task=2)
        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException:
            assert fail
        return [b for b in batches if b[1]]

    assert run() == []
    # one time is shared by more rows than a task has; two rows lack a part of the key
    put((None, 1), ("x", None), *((i, 5) for i in "abcde"))
    assert run([("f", 5), ("a", 6)]) == [(3, [(0, "x"), (1, ""), *((5, i) for i in "abcde")])]
    assert run([("b", 6), ("a", 7)], fail=True) == []
    assert run() == [(1, [(5, "f"), (6, "a")])], "with the ends that it had"
    assert run() == [(1, [(6, "b"), (7, "a")])]
    put(("late", 2))
    assert run() == []
    with sqlite3.connect(file) as db:
        db.execute("DELETE FROM m WHERE t > 5")
    assert run() == []
    put(("z", 5), ("b", 6))
    assert run() == [(1, [(5, "z"), (6, "b")])]


def test_prices_and_rates(spark):
    body = json.dumps({"p1": {"models": {"a": {"id": "a", "name": "A", "cost": {"input": 1, "output": 2}, "last_updated": "2025-01-01"}, "free": {"id": "free", "cost": {"input": 0, "output": 0}}}}, "p2": {"models": {"a": {"id": "a", "name": "A2", "cost": {"input": 3, "output": 4, "cache_read": 0.1}, "last_updated": "2025-06-01"}}}})
    got = catalogues.price_catalogue(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.model_id, r.display_name, r.input_price, r.cache_read_price) for r in got] == [("a", "A2", 3.0, 0.1)]
    rates = spark.createDataFrame([(json.dumps({"rates": {"EUR": 0.9, "JPY": 150, "USD": 7}}),)], "body string")
    assert {r.currency: r.rate for r in catalogues.exchange_rates(rates, ["EUR", "USD"]).collect()} == {"EUR": 0.9, "USD": 1.0}


def test_files(spark):
    p = spark.createDataFrame([("\\\\wsl$\\Ubuntu\\home\\u\\x.jsonl",), ("//WSL.localhost/Debian/y",), ("/home/z",)], "p string")
    assert [r[0] for r in p.select(files.wsl_distro(F.col("p"))).collect()] == ["Ubuntu", "Debian", None]
    assert files.wsl_roots(["U"], ["/a"], ["/b", "/b"]) == ["//wsl.localhost/U/a", "/b"]
    now = spark.createDataFrame([("a", True, 2), ("b", False, None)], "path string, ok boolean, v int")
    before = spark.createDataFrame([("a", True, 1), ("b", True, 1), ("c", True, 1)], "path string, ok boolean, v int")
    assert {r.path: r.v for r in files.last_good(now, before).collect()} == {"a": 2, "b": 1}
