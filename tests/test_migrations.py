"""Stored frames of older shapes."""

from pyspark.sql import functions as F

from meterlake.functions.calendar import epoch
from meterlake.plans.commands import Context, Usage
from meterlake.plans.materialize import DayStore, day_dependencies, observations
from meterlake.plans.migrations import added, dropped, migrated, renamed, retyped, shape_number
from meterlake.queries import bindings as B
from meterlake.queries.stored import _as_of_old

SF = "/root/testdata/sf0.001"


def test_steps_run_in_order_from_a_shape_on(spark):
    steps = (retyped(3, "n", "int"), renamed(1, "count", "n"), added(2, "kind", "string", "x"), dropped(4, "junk"))
    first = spark.createDataFrame([("1", "j"), ("many", None)], "count string, junk string")
    now = migrated(first, steps, 0)
    assert now.dtypes == [("n", "int"), ("kind", "string")] and sorted(map(str, (r.n for r in now.collect()))) == ["1", "None"]
    later = spark.createDataFrame([("7", "y", "j")], "n string, kind string, junk string")
    assert [tuple(r) for r in migrated(later, steps, 2).collect()] == [(7, "y")]
    assert migrated(now, steps, 4).columns == now.columns and shape_number({"a": steps, "b": ()}) == 4 and shape_number({}) == 0


def test_store_of_an_older_version(spark, tmp_path):
    sides = B.proxy(spark, SF), B.local(spark, SF)
    known, prices, c = B.sessions(spark, SF), B.prices(spark), Context(epoch(2024, 1, 6, 12))
    early = [d.where(F.col("timestamp") < epoch(2024, 1, 4) * u) for d, u in zip(sides, (1000, 1), strict=True)]
    late = [d.where(F.col("timestamp") < epoch(2024, 1, 7) * u) for d, u in zip(sides, (1000, 1), strict=True)]
    today = DayStore(spark, str(tmp_path / "now"))
    Usage(*early, known, prices, store=today).refresh_store(c)
    store = _as_of_old(spark, today, str(tmp_path / "old"))
    assert {r["shape"] for r in store.state().collect()} == {None} and store.read("facts").count() == today.read("facts").count()
    # rows that no day has come in today's shape too
    none = store.read("facts", "2030-01-01")
    assert none.count() == 0 and {"tool", "request_count"} <= set(none.columns) and "client" not in none.columns
    usage = Usage(*late, known, prices, store=store)
    assert usage.refresh_store(c)[-1] == "2024-01-05"
    assert {r["shape"] for r in store.state().collect()} == {None, 3}
    plain = Usage(*late, known, prices)
    shown = lambda u: sorted(map(tuple, u.facts(c).select("canonical_request_key", "tool", "status_code", "timestamp_ms").collect()), key=str)
    assert shown(usage) == shown(plain) and dict(usage.facts(c).dtypes)["status_code"] == "int"
    # filters reach the files through the steps
    assert "PushedFilters: [IsNotNull(client), EqualTo(client,codex)" in store.read("facts", before="2024-01-02").where("tool = 'codex'")._jdf.queryExecution().executedPlan().toString()
    store.rebuild(usage.merged, day_dependencies(*late, sessions=known, prices=prices), observations(*late), c.today())
    assert {r["shape"] for r in store.state().collect()} == {3} and shown(usage) == shown(plain)
