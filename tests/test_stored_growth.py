"""Stored days at size: files by day, hashes by request, sums of hashes, and plans that compute nothing twice."""

from pyspark.sql import functions as F

from meterlake.operators.merge import keyed_local, keyed_proxy, merge_facts, proxy_observations
from meterlake.operators.metrics import daily_summary, stated_tokens
from meterlake.operators.statistics import cells
from meterlake.plans.commands import Context, Usage
from meterlake.plans.materialize import DayStore, content, observations
from meterlake.queries import bindings as B

SF = "/root/testdata/sf0.001"


def test_a_day_has_files_for_its_size(spark, tmp_path):
    """Not one from every task: 4 tasks would leave up to 4 files a day in each table."""
    sides = B.proxy(spark, SF).repartition(4), B.local(spark, SF).repartition(4), B.remote(spark, SF).repartition(4)
    store = DayStore(spark, str(tmp_path / "d"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")  # tasks enough to show it
    try:
        done = Usage(sides[0], sides[1], B.sessions(spark, SF), B.prices(spark), sides[2], store).refresh_store(Context(B.AS_OF))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for table in ("facts", "seen"):
        assert len(list((tmp_path / "d" / table).rglob("*.parquet"))) <= 2 * (len(done) + 1), table


def test_content_is_the_sum_of_hashes(spark):
    rows = B.proxy(spark, SF)
    plain = rows.agg(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))).first()[0]
    assert rows.agg(content(rows)).first()[0] == plain and rows.where("false").agg(content(rows)).first()[0] is None
    by_day = rows.groupBy("model").agg(content(rows).alias("s")).agg(F.sum("s")).first()[0]
    assert by_day == plain


def test_a_plain_request_has_one_hash(spark):
    """Its key says no more than its message."""
    p, mine = B.proxy(spark, SF), B.local(spark, SF)
    n = p.select(F.timestamp_millis("timestamp").cast("date"), "message_id").unionByName(mine.select(F.timestamp_seconds("timestamp").cast("date"), "message_id").toDF("CAST(timestamp_millis(timestamp) AS DATE)", "message_id")).distinct().count()
    seen = observations(p, mine)
    assert seen.count() == n == seen.distinct().count()


def test_odd_keys_share_a_hash(spark):
    """Days whose rows have a key or a message in common share a hash, whatever the keys are made of."""
    odd = [(None, "t", "m"), ("t:m", "u", None), ("t:m", "u", "z"), (" t:m ", "u", ""), (None, None, "t:m"), (None, "t:m", "n"), (None, "t", "m:n"), ("t:m:n", "u", None), (None, "v", "m"), ("m", "u", None), (None, None, "m"), (None, "", "m"), (":m", "u", None), (None, "w", " "), (None, "t", " m"), ("x", "u", "z")]
    local = spark.createDataFrame([(f"s{i}", t, m, k, i * 86_400, "x", 1, 1) for i, (k, t, m) in enumerate(odd)], "session_id string, tool string, message_id string, request_key string, timestamp long, model string, input_tokens long, total_tokens long")
    proxy = spark.createDataFrame([(f"s{i}", t, m, k, i * 86_400_000, "x", 1) for i, (k, t, m) in enumerate(odd)], "session_id string, client_tool string, message_id string, canonical_request_key string, timestamp long, model string, input_tokens long")
    empty = [d.where("false") for d in (proxy, local)]
    rows = keyed_local(local).selectExpr("timestamp div 86400 AS day", "k", "message_id").collect()
    assert [r.k for r in rows] == [r.k for r in keyed_proxy(proxy).orderBy("timestamp").collect()]
    for seen in (observations(empty[0], local), observations(proxy, empty[1]), observations(proxy.where("timestamp % 172800000 = 0"), local.where("timestamp % 172800 <> 0"))):
        have = {}
        for r in seen.withColumn("day", F.datediff(F.col("local_date").cast("date"), F.lit("1970-01-01").cast("date"))).collect():
            have.setdefault(r.day, set()).add(r.h)
        for a in rows:
            for b in rows:
                if a.k == b.k or (a.message_id is not None and a.message_id.strip() and a.message_id == b.message_id):
                    assert have[a.day] & have[b.day], (a, b)


def test_summaries_follow_from_cells(spark):
    """Also totals that are stated otherwise than as the sums of their parts."""
    dated = B.facts(spark, SF).withColumn("local_date", F.timestamp_seconds("timestamp_sec").cast("date").cast("string")).withColumn("total_tokens", F.col("total_tokens") + F.col("timestamp_sec") % 3)
    shown = lambda d: [tuple(round(v + 1e-9, 6) if isinstance(v, float) else v for v in r) for r in d.orderBy("local_date").collect()]
    assert shown(daily_summary(cells(dated, 86_400, "UTC", "local_date", more=[stated_tokens()]))) == shown(daily_summary(dated))


def test_only_rows_without_a_session_meet_messages(spark):
    """The others aren't dealt out by message, and blank ones come out as before."""
    rows = [("a", "s1"), ("a", ""), ("b", None), ("c", " "), (None, ""), ("", None), (None, "s2")]
    schema = "message_id string, session_id string, canonical_request_key string, timestamp long, client_tool string, model string"
    proxy = spark.createDataFrame([(m, s, f"k{i}", i, "t", "x") for i, (m, s) in enumerate(rows)], schema)
    messages = spark.createDataFrame([("a", "s8", 1), ("a", "s9", 2), ("b", "s7", 1), ("c", "", 1), ("", "s6", 1), ("d", "s5", 1)], "message_id string, session_id string, timestamp long")
    assert {r.k: r.session_id for r in proxy_observations(proxy, messages).collect()} == {"k0": "s1", "k1": "s9", "k2": "s7", "k3": None, "k4": None, "k5": None, "k6": "s2"}


def test_models_are_priced_from_what_is_given(spark):
    """The window over keyed rows is planned once for each side, not again for the names of models."""
    plan = merge_facts(B.proxy(spark, SF), B.local(spark, SF), B.remote(spark, SF), None, B.prices(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 2


def test_inputs_have_more_files_as_they_grow(spark, tmp_path):
    """Whatever the number of rows, 8 files were written before; and no file holds more than its share of days."""
    from meterlake.queries.stored import _by_day

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        _by_day(B.local(spark, SF).repartition(4), F.col("timestamp")).write.parquet(str(tmp_path / "f"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    rows = spark.read.parquet(str(tmp_path / "f"))
    assert len(list((tmp_path / "f").glob("*.parquet"))) > 1 and rows.columns == B.local(spark, SF).columns
    assert rows.exceptAll(B.local(spark, SF)).isEmpty() and rows.count() == B.local(spark, SF).count()
