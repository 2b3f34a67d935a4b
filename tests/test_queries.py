"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from meterlake.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, float):
        return f"{round(x, 3) + 0.0:.3f}"
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(tuple(cell(float(v) if t in ("double", "int", "bigint") and v is not None else v) for v, t in zip(r, [dict(got.dtypes)[c] for c in columns], strict=True)) for r in got.select(columns).collect())
    relation = tables.execute(SQL[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    kinds = dict(got.dtypes)
    theirs = sorted(tuple(cell(float(r[i]) if kinds[c] in ("double", "int", "bigint") and r[i] is not None else r[i]) for i, c in zip(place, columns, strict=True)) for r in relation.fetchall())
    assert mine == theirs


def test_matching_is_a_replay(spark):
    """Greedy matching against the plain loop."""
    from pyspark.sql import functions as F

    from meterlake.operators.reconcile import match_records

    tokens = "input_tokens long, output_tokens long, cache_create_tokens long, cache_read_tokens long, model string"
    p = spark.createDataFrame([(f"p{i}", i * 7000, 0, 10, i % 3, 0, 0, "V/M" if i % 2 else "m") for i in range(120)], f"message_id string, timestamp long, request_end_time long, {tokens}")
    mine = spark.createDataFrame([(f"k{i}", f"s{i}", i * 11, 10, i % 3, 0, 0, "x/m") for i in range(90)], f"request_key string, session_id string, timestamp long, {tokens}")
    got = {r.row: (r.request_key, r.state) for r in match_records(p, mine).collect()}
    used, want = set(), {}
    local = sorted(mine.collect(), key=lambda r: (r.timestamp, r.request_key))
    for r in sorted(p.collect(), key=lambda r: (r.timestamp, r.message_id)):
        at = r.timestamp // 1000
        near = sorted(((abs(x.timestamp - at), n) for n, x in enumerate(local) if x.output_tokens == r.output_tokens and n not in used and abs(x.timestamp - at) <= 30))
        clear = len(near) == 1 or (len(near) > 1 and near[0][0] <= 5 and near[1][0] - near[0][0] >= 10)
        if clear:
            used.add(near[0][1])
            want[r.message_id] = (local[near[0][1]].request_key, "known")
        else:
            want[r.message_id] = (None, "ambiguous" if near else "unmatched")
    assert got == want
    assert {s for _, s in want.values()} == {"known", "ambiguous", "unmatched"} or len(want) == 120
    assert match_records(p.where(F.lit(False)), mine).count() == 0
    # another total is another request; a row without a key is never used up
    other = match_records(p, mine.withColumn("total_tokens", F.lit(99).cast("long")))
    assert {r.state for r in other.collect()} == {"unmatched"}
    keyless = mine.where("request_key = 'k0'").withColumn("request_key", F.lit(None).cast("string"))
    near = p.where("message_id IN ('p0', 'p3')")
    assert sorted((r.row, r.session_id, r.state) for r in match_records(near, keyless).collect()) == [("p0", "s0", "known"), ("p3", "s0", "known")]
    once = mine.where("request_key = 'k0'")
    assert sorted(r.state for r in match_records(near, once).collect()) == ["known", "unmatched"]


def test_matching_holds_only_the_window():
    """A run without gaps is settled as it streams by, long before its end."""
    import pyarrow as pa

    from meterlake.operators.reconcile import _assigned

    read = []

    def batches():
        for i in range(500):
            read.append(i)
            rows = [(0, i * 20, True, f"k{i:04}", "s"), (0, i * 20 + 1, False, f"p{i:04}", None)]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns], ["run", "at", "local", "name", "session_id"])

    settled = 0
    for out in _assigned(batches()):
        settled += len(out)
        assert settled >= len(read) - 3
    assert settled == 500


def test_sessions_are_met_without_listing_pairs(spark):
    """Sweeps against all pairs: sessions without a model, without times, of several rows, and requests at their edges."""
    import random

    from meterlake.operators import sessions as S

    rng = random.Random(4)
    rows = []
    for i in range(80):
        start = rng.choice([None, 0, rng.randrange(1000, 40_000)])
        rows.append((rng.choice([f"s{i}", f"s{i % 9}", "", None]) if rng.random() < 0.4 else f"s{i}", rng.choice([[], None, ["m"], ["M", "m", "other"], ["n/x"]]), start, rng.choice([None, 0, (start or 5) + rng.randrange(9000)]), rng.choice([None, rng.randrange(1000, 40_000)])))
    known = spark.createDataFrame(rows, "session_id string, models array<string>, start_time long, end_time long, last_modified long")
    edges = [t for r in rows for t in (r[2], r[3], r[4]) if t]
    asked = [(f"r{i}", rng.choice([None, rng.choice(edges) + rng.choice([-61, -60, -15, 0, 15, 60, 61]), rng.randrange(45_000)]), rng.choice(["m", "other", "n/x", "", None, "zz"])) for i in range(400)]
    requests = spark.createDataFrame(asked, "id string, at long, model string")
    pairs = [tuple(r) for r in S.session_candidates(requests, known, "id", "at").collect()]
    of = {}
    for r, session in pairs:
        of.setdefault(r, []).append(session)
    want = {r: (c[0], "known") if len(c) == 1 else (None, "ambiguous" if c else "unmatched") for r, _, _ in asked for c in [of.get(r, [])]}
    assert {r.id: (r.session_id, r.state) for r in S.resolved_sessions(requests, known, "id", "at").collect()} == want
    count = {}
    for _, session in pairs:
        count[session] = count.get(session, 0) + 1
    assert {r.session_id: r.unresolved for r in S.unresolved_per_session(requests, known, "id", "at").collect()} == count
    assert {s for _, s in want.values()} == {"known", "ambiguous", "unmatched"}
    assert S.resolved_sessions(requests.limit(0), known, "id", "at").count() == 0 and {r.state for r in S.resolved_sessions(requests, known.limit(0), "id", "at").collect()} == {"unmatched"}
