"""Lookups merge few keys; what they give is what the merge of everything gives."""

import random

from pyspark.sql import functions as F

from meterlake.operators import lookup
from meterlake.operators.filters import tool_in
from meterlake.operators.merge import merge_facts
from meterlake.operators.sessions import all_sessions
from meterlake.plans.commands import Context
from meterlake.queries import bindings as B
from meterlake.schemas import FACTS, LOCAL, PROXY

SF = "/root/testdata/sf0.001"


def made(spark, seed):
    """Observations with repeated keys, keys seen at distant times, blank sessions, and messages that name another row's session."""
    r = random.Random(seed)
    at = lambda: r.choice([r.randrange(3600), r.randrange(40 * 3600), r.randrange(900 * 3600)])
    name = lambda: r.choice(["s1", "s2", "s3", "", " ", None])
    some = lambda n: f"m{r.randrange(n)}" if r.random() < 0.9 else r.choice(["", None])
    p = [{"timestamp": at() * 1000 + r.randrange(1000), "message_id": some(60), "canonical_request_key": r.choice([None, f"k{r.randrange(40)}"]), "session_id": name(), "client_tool": r.choice("ab"), "model": "m", "input_tokens": r.randrange(5), "output_tokens": 1, "status_code": r.choice([200, 404, None]), "duration_ms": r.randrange(9)} for _ in range(120)]
    mine = [[{"timestamp": at(), "message_id": some(60), "request_key": r.choice([None, None, f"k{r.randrange(40)}"]), "session_id": name(), "tool": r.choice("ab"), "model": "m", "input_tokens": r.randrange(5), "output_tokens": 2, "total_tokens": r.randrange(9)} for _ in range(n)] for n in (120, 40)]
    frame = lambda rows, schema: spark.createDataFrame([tuple(x.get(f) for f in schema.fieldNames()) for x in rows], schema)
    return frame(p, PROXY), frame(mine[0], LOCAL), frame(mine[1], LOCAL)


def shown(d):
    return sorted((tuple(r) for r in d.collect()), key=str)


def test_sessions_and_newest_rows(spark):
    sides = made(spark, 1)
    everything = spark.createDataFrame(merge_facts(*sides, include_errors=True).collect(), FACTS)
    for s in ("s1", "nobody"):
        assert shown(lookup.session_facts(s, *sides, include_errors=True)) == shown(everything.where(F.col("session_id") == s))
    for count, chosen in ((4, lambda d: d), (20, lambda d: d.where(tool_in(F.col("tool"), "a"))), (100_000, lambda d: d)):
        got = lookup.newest(lookup.newest_facts(count, chosen, *sides, include_errors=True), count - 2, 2)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in lookup.newest(chosen(everything), count - 2, 2).collect()]
    none = [d.where(F.lit(False)) for d in sides]
    assert lookup.newest_facts(3, lambda d: d, *none).count() == 0 and lookup.session_facts("s1", *none).count() == 0


def test_sessions_merge_once(spark):
    """One merge in the plan; metadata of repeated and of nameless sessions stays."""
    known = B.sessions(spark, SF)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(all_sessions(B.facts(spark, SF), known)).count("FullOuter") == 2  # the merge, and the metadata
    detail = B.usage(spark, SF).session_detail(Context(B.AS_OF), "s42")
    assert plan(detail).count("FullOuter") == 2 and plan(detail).count("LeftSemi") >= 3
    odd = known.where("session_id IN ('s1', 's2')").unionByName(known.where("session_id = 's1'").withColumns({"session_id": F.lit("bare"), "tool": F.lit("x")}))
    odd = odd.unionByName(odd.where("session_id = 'bare'")).unionByName(odd.where("session_id = 'bare'").withColumn("session_id", F.lit(None).cast("string")))
    facts = B.facts(spark, SF).where("session_id = 's1'")
    got = all_sessions(facts, odd)
    assert sorted((r.session_id or "-", r.has_facts) for r in got.collect()) == [("-", False), ("bare", False), ("bare", False), ("s1", True), ("s2", False)]
    assert got.where("session_id = 'bare'").distinct().count() == 1 and all_sessions(facts, odd, False).count() == 1
