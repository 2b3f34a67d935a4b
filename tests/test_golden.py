"""Small cases with known results."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from meterlake.functions import calendar as cal
from meterlake.functions.keys import project_name, source_id
from meterlake.functions.models import match_score
from meterlake.functions.numbers import cost, share_of, short_number, without_cache
from meterlake.operators import metrics, pricing, sequences, statistics, survival
from meterlake.operators.merge import merge_facts
from meterlake.schemas import FACTS, LOCAL, LOCAL_ONLY, MERGED, PRICES, PROXY, PROXY_ONLY


def rows(spark, schema, *items):
    return spark.createDataFrame([tuple(x.get(f.name) for f in schema.fields) for x in items], schema)


def fact(**kw):
    base = {"canonical_request_key": "k", "session_id": "s", "tool": "t", "timestamp_sec": 0, "timestamp_ms": 0, "model": "m", "input_tokens": 0, "output_tokens": 0, "cache_create_tokens": 0, "cache_read_tokens": 0, "request_count": 1, "estimated_cost": 0.0, "coverage_origin": PROXY_ONLY}
    out = base | kw
    out.setdefault("total_tokens", sum(out[c] for c in ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")))
    return out


def test_metrics(spark):
    f = rows(spark, FACTS, fact(input_tokens=10, output_tokens=20, cache_create_tokens=3, cache_read_tokens=2, estimated_cost=1.25, status_code=200, duration_ms=500, output_tokens_per_second=40.0, ttft_ms=300), fact(input_tokens=10, output_tokens=20, cache_create_tokens=3, cache_read_tokens=2, estimated_cost=1.25, status_code=500, duration_ms=1000, output_tokens_per_second=20.0, ttft_ms=700))
    m = metrics.measured(f).first()
    assert (m.requests, m.total_tokens, m.cost, m.success_requests, m.server_errors) == (2, 70, 2.5, 1, 1)
    assert (m.rate_tokens, m.rate_ms, m.min_rate, m.max_rate, m.min_ttft_ms, m.max_ttft_ms) == (40, 1500, 20.0, 40.0, 300, 700)
    assert metrics.measured(f.limit(0)).first().requests == 0


def test_weights_and_redirects(spark):
    f = rows(spark, FACTS, fact(request_count=7, status_code=302), fact(status_code=None, coverage_origin=LOCAL_ONLY))
    d = metrics.daily_summary(f.withColumn("local_date", F.lit("d"))).first()
    assert (d.requests, d.visible_requests, d.success_requests, d.local_only, d.proxy_backed, d.is_partial) == (8, 1, 7, 1, 7, True)


def test_ranking_percent_falls_back_to_tokens(spark):
    free = rows(spark, FACTS, fact(model="a", input_tokens=40), fact(model="b", input_tokens=60))
    assert [(r.model, round(r.percent)) for r in statistics.ranking(free, "model").collect()] == [("b", 60), ("a", 40)]
    paid = rows(spark, FACTS, fact(model="a", input_tokens=40, estimated_cost=2.0), fact(model="b", input_tokens=60))
    assert {r.model: r.percent for r in statistics.ranking(paid, "model").collect()} == {"a": 100.0, "b": 0.0}


def test_first_tokens_need_a_rate(spark):
    assert statistics.first_tokens_by_model(rows(spark, FACTS, fact(ttft_ms=5))).count() == 0


def test_counter_deltas(spark):
    c = "struct<input:long,output:long,cache_create:long,cache_read:long>"
    events = spark.createDataFrame(
        [("f", 1, (500, 41, 0, 120), None), ("f", 2, (540, 60, 0, 130), None), ("f", 3, None, (2, 1, 0, 0)), ("f", 4, (18, 3, 0, 6), None), ("g", 1, (8, 7, 0, 0), (5, 2, 0, 2))],
        f"file string, n int, total {c}, last {c}",
    )
    got = [tuple(r.delta) for r in sequences.counter_deltas(events, "file", ["n"]).orderBy("file", "n").collect()]
    assert got == [(380, 41, 0, 120), (30, 19, 0, 10), (2, 1, 0, 0), (12, 3, 0, 6), (3, 2, 0, 2)]


@pytest.mark.parametrize(
    ("times", "as_of", "want"),
    [
        ([(0, 1000), (3600, 500)], 7200, (0, 1500, 2)),
        ([(0, 1000)], 5 * 3600, None),
        ([(0, 10), (6 * 3600, 20)], 6 * 3600 + 5, (6 * 3600, 20, 1)),
        ([(0, 10), (4 * 3600, 20), (5 * 3600, 750)], 5 * 3600 + 60, (5 * 3600, 750, 1)),
    ],
)
def test_blocks(spark, times, as_of, want):
    f = rows(spark, FACTS, *(fact(timestamp_sec=t, input_tokens=n) for t, n in times))
    got = survival.current_blocks(f, as_of, start=0).first()
    assert (None if got is None else (got.start_epoch, got.used_tokens, got.used_requests)) == want


def test_burn_and_baseline(spark):
    as_of = 100 * 3600
    f = rows(spark, FACTS, *(fact(timestamp_sec=as_of - 3000 + 300 * i, input_tokens=100) for i in range(10)))
    b = survival.burn_rate(f, as_of).first()
    assert (b.sample_requests, b.sample_seconds, b.confidence, round(b.tokens_per_hour)) == (10, 3000, "high", 1200)
    hours = rows(spark, FACTS, *(fact(timestamp_sec=(90 + i) * 3600, input_tokens=1000) for i in range(3)))
    assert survival.baseline(hours, as_of).first().avg_tokens_per_hour == 1000.0
    assert survival.baseline(hours.limit(2), as_of).count() == 0
    nothing = survival.survival(f.limit(0), as_of).first()
    assert (nothing.source_kind, nothing.confidence, nothing.start_epoch) == ("none", "low", None)


def test_cost(spark):
    one = spark.range(1).select(cost(*(F.lit(x) for x in (1_000_000, 500_000, 200_000, 100_000)), F.lit(3.0), F.lit(15.0), F.lit(1.5), F.lit(0.3)).alias("c")).first().c
    assert round(one, 6) == round(3 + 7.5 + 0.06 + 0.15, 6)


def test_business_days(spark):
    at = cal.epoch(2024, 5, 2, 1, 30)
    assert spark.range(1).select(cal.business_date(F.lit(at), boundary=4).alias("d")).first().d == date(2024, 5, 1)
    assert cal.business_day_bounds(date(2024, 5, 1), boundary=4) == (cal.epoch(2024, 5, 1, 4), cal.epoch(2024, 5, 2, 4))
    start, end = cal.business_day_bounds(date(2026, 3, 8), "America/New_York")
    assert end - start == 23 * 3600
    gap = cal.epoch(2026, 3, 8, 8, 30)
    assert spark.range(1).select(cal.business_date(F.lit(gap), "America/New_York", 4).alias("d")).first().d == date(2026, 3, 8)
    assert cal.business_day_bounds(date(2026, 11, 1), "America/New_York", 1)[0] == cal.epoch(2026, 11, 1, 5)


def test_merge_precedence(spark):
    p = {"timestamp": 5_500, "message_id": "1", "client_tool": "t", "model": "m", "input_tokens": 150, "output_tokens": 250, "cache_create_tokens": 0, "cache_read_tokens": 0, "status_code": 200, "estimated_cost": 0.99, "cost_locked": True, "session_id": None}
    mine = {"session_id": "s", "tool": "t", "message_id": "1", "timestamp": 4, "model": "m", "input_tokens": 100, "output_tokens": 200, "cache_create_tokens": 800, "cache_read_tokens": 900, "total_tokens": 2000, "request_count": 1, "explicit_estimated_cost": 0.42}
    f = merge_facts(rows(spark, PROXY, p), rows(spark, LOCAL, mine)).first()
    assert (f.total_tokens, f.cache_create_tokens, f.cache_read_tokens, f.estimated_cost, f.coverage_origin) == (2100, 800, 900, 0.99, MERGED)
    assert (f.session_id, f.timestamp_sec, f.timestamp_ms) == ("s", 4, 5_500)
    unlocked = merge_facts(rows(spark, PROXY, p | {"cost_locked": False}), rows(spark, LOCAL, mine)).first()
    assert unlocked.estimated_cost == 0.42
    failed = merge_facts(rows(spark, PROXY, p | {"status_code": 500}), rows(spark, LOCAL, mine))
    assert failed.count() == 0
    other = merge_facts(rows(spark, PROXY, p), rows(spark, LOCAL, mine | {"message_id": "2"})).collect()
    assert {r.coverage_origin for r in other} == {PROXY_ONLY, LOCAL_ONLY}
    assert merge_facts(rows(spark, PROXY), rows(spark, LOCAL)).count() == 0


def test_merge_is_idempotent(spark):
    p = rows(spark, PROXY, *({"timestamp": i * 1000, "message_id": str(i), "client_tool": "t", "model": "m", "input_tokens": i, "output_tokens": 1, "cache_create_tokens": 0, "cache_read_tokens": 0, "status_code": 200, "estimated_cost": 0.0, "cost_locked": True} for i in range(5)))
    mine = rows(spark, LOCAL, *({"session_id": "s", "tool": "t", "message_id": str(i), "timestamp": i, "model": "m", "input_tokens": 1, "output_tokens": 1, "cache_create_tokens": 0, "cache_read_tokens": 0, "total_tokens": 2, "request_count": 1} for i in range(3, 9)))
    once, twice = merge_facts(p, mine), merge_facts(p.union(p), mine.union(mine), mine)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_fuzzy_prices(spark):
    prices = rows(spark, PRICES, {"model_id": "gpt-5", "input_price": 1.0, "source": "api", "rank": 0}, {"model_id": "GPT-5", "input_price": 2.0, "source": "api", "rank": 1}, {"model_id": "gpt5", "input_price": 3.0, "source": "custom", "rank": 2})
    models = spark.createDataFrame([("gpt-5",), ("Gpt-5",), ("openai/gpt-5-mini",), ("GPT_5!",), ("other",), ("",)], "model string")
    got = {r.model: r.price_id for r in pricing.priced_models(models, prices).collect()}
    assert got == {"gpt-5": "gpt-5", "Gpt-5": "gpt-5", "openai/gpt-5-mini": "gpt-5", "GPT_5!": "gpt5", "": "gpt5"}
    assert pricing.priced_models(models, prices, exact=True).count() == 1
    assert [r[0] for r in spark.createDataFrame([("a", "a"), ("A", "a"), ("xay", "A"), ("a-b", "A_B"), ("a", "z")], "m string, p string").select(match_score(F.col("m"), F.col("p"))).collect()] == [0, 1, 2, 3, None]


def test_small_functions(spark):
    r = spark.range(1).select(
        F.concat_ws(",", *(share_of(F.lit(11).cast("long"), F.lit(i).cast("long"), F.lit(3).cast("long")).cast("string") for i in range(3))).alias("shares"),
        without_cache(F.lit(5), F.lit(9), True).alias("a"),
        without_cache(F.lit(5), F.lit(9), False).alias("b"),
        project_name(F.lit("C:\\work\\my app\\")).alias("p"),
        source_id(F.lit("sk"), F.lit(None).cast("string")).alias("s"),
        short_number(F.lit(1_234_567)).alias("n"),
    ).first()
    assert (r.shares, tuple(r.a), tuple(r.b), r.p, len(r.s), r.n) == ("4,4,3", (0, 5), (0, 9), "my app", 16, "1.2M")
