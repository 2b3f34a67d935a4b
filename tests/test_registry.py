"""Looks at sources: only what has changed is parsed again, and tables are read on from where they were left."""

import json
import os

from pyspark.sql import functions as F

from meterlake.sources.files import folder_project
from meterlake.sources.registry import SOURCES, KeysetCheckpoint, ScanCache, Source


def session(path, *tokens):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps({"type": "assistant", "timestamp": 1700000000 + i, "message": {"id": f"{path.stem}-{i}", "model": "m", "usage": {"input_tokens": n, "output_tokens": 0}}}) for i, n in enumerate(tokens)) + " " * 120)


def held(cache):
    return sorted((r.session_id, r.input_tokens) for r in cache.read().collect())


def test_only_changed_sessions_are_parsed(spark, tmp_path):
    root, opened = tmp_path / "logs", []
    real = SOURCES["claude_code"]

    def reader(spark, paths, tool):
        opened.append(sorted(os.path.basename(p) for p in paths))
        return real.reader(spark, paths, tool=tool)

    cache = ScanCache(spark, str(tmp_path / "cache"), Source(real.tool, real.glob, reader, real.session), buckets=2)
    assert cache.read().count() == 0
    session(root / "a b.jsonl", 5, 6)
    session(root / "c.jsonl", 7)
    session(root / "c/subagents/helper.jsonl", 1)
    session(root / "d.jsonl", 9)
    assert cache.refresh([str(root)]) == {"new": 3}
    assert sorted(n for _, n in held(cache)) == [1, 5, 6, 7, 9]
    assert cache.refresh([str(root)]) == {} and len(opened) == 1
    session(root / "c/subagents/helper.jsonl", 1, 2)
    (root / "d.jsonl").unlink()
    session(root / "e.jsonl", 4)
    assert cache.refresh([str(root)]) == {"dirty": 1, "removed": 1, "new": 1}
    assert opened[1] == ["c.jsonl", "e.jsonl", "helper.jsonl"]
    assert sorted(n for _, n in held(cache)) == [1, 2, 4, 5, 6, 7]
    for p in root.rglob("*.jsonl"):
        p.unlink()
    assert cache.refresh([str(root)]) == {"removed": 3} and held(cache) == []


def test_sources_that_name_their_sessions_are_parsed_whole(spark, tmp_path):
    doc = lambda i, n: {"id": i, "sessionID": "s", "role": "assistant", "modelID": "m", "time": {"created": 1767225600000}, "tokens": {"input": n}}
    (tmp_path / "m").mkdir()
    (tmp_path / "m/1.json").write_text(json.dumps(doc("1", 3)))
    cache = ScanCache(spark, str(tmp_path / "cache"), SOURCES["opencode"])
    assert cache.refresh([str(tmp_path / "m")]) == {"new": 1}
    (tmp_path / "m/2.json").write_text(json.dumps(doc("2", 4)))
    assert cache.refresh([str(tmp_path / "m")]) == {"dirty": 1}
    assert held(cache) == [("s", 3), ("s", 4)]


def test_keyset_checkpoint(spark, tmp_path):
    at = KeysetCheckpoint(spark, str(tmp_path / "at"), "t", "id", full_every=3)
    rows = lambda *x: spark.createDataFrame(list(x), "t long, id long")
    ids = lambda d: sorted(r.id for r in d.collect())
    table = rows((1, 1), (2, 9))
    got = at.unread(table)
    assert got.whole and ids(got.rows) == [1, 9]
    at.advance(got)
    table = rows((1, 1), (2, 9), (2, 10), (3, 2))
    got = at.unread(table)
    assert not got.whole and ids(got.rows) == [2, 10]
    at.advance(got)
    assert ids(at.unread(table).rows) == []
    assert at.unread(rows((1, 1))).whole, "the table has been set back"
    assert at.unread(table.withColumn("more", F.lit(1))).whole, "another shape"
    at.advance(at.unread(table))
    assert at.unread(table).whole, "every third read is of all rows"
    at.advance(at.unread(rows()))
    assert at.state().last_time == 3
    assert ids(at.unread(rows((5, 1), (None, 7))).rows) == [1, 7]


def test_rows_that_arrive_during_a_read_come_with_the_next(spark, tmp_path):
    at, folder = KeysetCheckpoint(spark, str(tmp_path / "at"), "t", "id"), str(tmp_path / "rows")
    put = lambda *x: spark.createDataFrame(list(x), "t long, id string").write.mode("append").json(folder)
    table = lambda: spark.read.schema("t long, id string").json(folder)
    put((1, "a"))
    first = at.unread(table())
    put((1, "b"), (2, "c"))
    again = KeysetCheckpoint(spark, str(tmp_path / "at"), "t", "id")
    assert [r.id for r in first.rows.collect()] == ["a"]
    at.advance(first)
    second = again.unread(table())
    assert sorted(r.id for r in second.rows.collect()) == ["b", "c"]
    assert sorted(r.id for r in again.unread(table()).rows.collect()) == ["b", "c"], "a read that wasn't taken in comes again"


def test_folder_project(spark):
    paths = [("/h/projects/-home-u-shop/x.jsonl",), ("C:\\h\\projects\\-w-a\\t\\y.jsonl",), ("/h/projects/--/z.jsonl",), ("/elsewhere/z.jsonl",)]
    assert [r[0] for r in spark.createDataFrame(paths, "p string").select(folder_project(F.col("p"))).collect()] == ["shop", "a", None, None]
