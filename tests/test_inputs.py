"""Inputs in files: what is opened, and that days come out as if all had been read."""

from pyspark.sql import functions as F

from meterlake.functions.calendar import epoch
from meterlake.plans.commands import Context, Usage
from meterlake.plans.inputs import FiledInput
from meterlake.plans.materialize import DayStore, day_dependencies
from meterlake.queries import bindings as B

SF = "/root/testdata/sf0.001"
NOON = epoch(2024, 1, 20, 12)


def by_day(rows, unit, folder):
    """One file for each day."""
    day = F.timestamp_seconds(F.col("timestamp") / unit).cast("date").cast("string")
    rows.withColumn("_day", day).repartition("_day").write.partitionBy("_day").mode("append").parquet(folder)


def test_only_new_files_are_opened(spark, tmp_path):
    sides = {"proxy": (B.proxy(spark, SF), 1000), "local": (B.local(spark, SF), 1), "remote": (B.remote(spark, SF), 1)}
    root, opened = tmp_path / "a b", []
    for name, (rows, unit) in sides.items():
        by_day(rows, unit, str(root / name))

    def load(paths):
        opened.extend(paths)
        return spark.read.parquet(*paths)

    files = {name: FiledInput(spark, str(tmp_path / "index" / name), [str(root / name)], load, F.expr(f"timestamp div {unit}")) for name, (_, unit) in sides.items()}
    known, prices, c = B.sessions(spark, SF), B.prices(spark), Context(NOON)
    store = DayStore(spark, str(tmp_path / "days"))
    assert len(Usage.of_files(files, known, prices, store).refresh_store(c)) == 19
    deps = day_dependencies(*(rows for rows, _ in sides.values()), sessions=known, prices=prices)
    assert store.stale(deps, c.today()).count() == 0

    # nothing has changed: no file is opened to learn that
    opened.clear()
    assert Usage(*(rows for rows, _ in list(sides.values())[:2]), known, prices, sides["remote"][0], store, files).refresh_store(c) == [] and opened == []

    # a late row on one day: its file is opened, and those of the days that share a request with it
    extra = sides["local"][0].where(F.col("timestamp").between(epoch(2024, 1, 5), epoch(2024, 1, 6) - 1)).limit(1).withColumn("message_id", F.lit("never seen")).withColumn("output_tokens", F.lit(77).cast("long"))
    extra.write.mode("append").parquet(str(root / "local/_day=2024-01-05"))
    usage = Usage(*(rows for rows, _ in list(sides.values())[:2]), known, prices, sides["remote"][0], store, files)
    again = usage.refresh_store(c)
    days = {p.split("_day=")[1][:10] for p in opened}
    assert "2024-01-05" in again and len(again) <= 3 and days <= {"2024-01-04", "2024-01-05", "2024-01-06"}
    plain = Usage(sides["proxy"][0], sides["local"][0].unionByName(extra), known, prices, sides["remote"][0])
    shown = lambda d: sorted(map(tuple, d.select("canonical_request_key", "timestamp_ms", "total_tokens", "session_id").collect()), key=str)
    assert shown(store.read("facts")) == shown(plain.facts(c).where(F.col("timestamp_sec") < epoch(2024, 1, 20)))

    # a file that goes takes its rows along; one without rows is not opened twice
    folder = root / "local/_day=2024-01-03"
    for f in folder.iterdir():
        f.unlink()
    extra.where(F.lit(False)).coalesce(1).write.mode("append").parquet(str(root / "local/_day=2024-01-03"))
    assert len(files["local"].refresh()) == 1 and files["local"].refresh() == []
    assert files["local"].days().where("local_date = '2024-01-03'").count() == 0
    assert "2024-01-03" in usage.refresh_store(c)
    left = sides["local"][0].where(~F.col("timestamp").between(epoch(2024, 1, 3), epoch(2024, 1, 4) - 1)).unionByName(extra)
    plain = Usage(sides["proxy"][0], left, known, prices, sides["remote"][0])
    assert shown(store.read("facts")) == shown(plain.facts(c).where(F.col("timestamp_sec") < epoch(2024, 1, 20)))


def test_rows_must_know_their_file(spark, tmp_path):
    rows = spark.createDataFrame([("s", 5), ("s", None)], "session_id string, timestamp long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    at = lambda load: FiledInput(spark, str(tmp_path / "x"), [str(tmp_path / "in")], load, F.col("timestamp"))
    try:
        at(lambda paths: spark.read.parquet(*paths).distinct()).refresh()
        raise AssertionError("rows of no file were taken")
    except ValueError:
        pass
    plain = at(lambda paths: spark.read.parquet(*paths))
    assert len(plain.refresh()) == 1 and sorted((r.local_date or "", r.n) for r in plain.days().collect()) == [("", 1), ("1970-01-01", 1)]
    assert plain.in_ranges([(10, None)]).count() == 0 and plain.in_ranges([(0, 6)]).count() == 2 and plain.on_days([]).count() == 0
