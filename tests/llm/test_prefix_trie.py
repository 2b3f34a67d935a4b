import hashlib
import random
import zlib

import duckdb
import numpy as np

from meterlake.llm import prefix_trie, queries
from meterlake.llm.prefix_trie import Louds, conversation_trie
from meterlake.llm.running import running_sums
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, id string, n long, shard string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0], x[1].encode(), x[2].encode()))] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(int(c / 5) * 5, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for k, members in nodes.items():
        under = [x for x in nodes if x[: len(k)] == k]
        childless = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        children = sum(len(x) == len(k) + 1 for x in under)
        parent = min(nodes[k[:-1]]) if k else None
        out.add((min(members), len(k), parent, len(members), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)


def held(spark, rows, **kw):
    found = [tuple(r) for r in conversation_trie(frame(spark, rows), **kw).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_odd_turns(spark):
    rows = [(1, 1, "user", "hi"), (1, None, "system", None), (1, 1, "user", "hi"), (1, 1, None, "é\U0001f600"), (None, 1, "user", "lost"), (5, None, None, None), (6, 3, "", ""), (-7, 1, "user", "hi"), (-5, 2, "a", "b"), (8, 9, "user", "x" * 100_000)]
    held(spark, rows)
    held(spark, [])
    held(spark, [(7, None, None, None)])
    held(spark, [(3, 1, "a", "b:1"), (4, 1, "a1:b", ""), (9, 1, "a", "b:1")])


def test_shards_of_several_levels(spark):
    rng = random.Random(3)
    rows = []
    for c in range(120):
        for t in range(rng.choice([0, 1, 2, 5, 9, 12])):
            rows.append((c, t, "user", rng.choice("ab") if rng.random() < 0.9 else f"own {c}"))
    for shard in (2, 3, 16, 4096):
        held(spark, rows, shard=shard)


def test_many_forests(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FOREST_NODES", 4)
    rows = [(c, t, "user", str(c // 7 if t < 10 else c)) for c in range(80) for t in range(11)]
    held(spark, rows)


def test_long_copies(spark):
    rows = [(c, t, "user", f"text {t}") for c in (10, 15, 20) for t in range(120)]
    held(spark, rows)


def test_running_sums_over_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = spark.range(3000).select(F.expr("id % 1009 div 1000").alias("k"), F.col("id").alias("at"), (F.col("id") % 5).alias("v"))
        found = running_sums(rows, "k", ["at"], {"s": "v"}, ["at"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want, have = {}, {}
    for i in range(3000):
        k = i % 1009 // 1000
        want[i] = have[k] = have.get(k, 0) + i % 5
    assert {r["at"]: r.s for r in found} == want


def test_louds_bits():
    # a root with children b (with child d) and c, and a lone root
    trie = Louds([b"d", b"a", b"c", b"b", b"z"], [b"b", None, b"a", b"a", None], np.array([2, 0, 1, 1, 0]), np.array([[4], [1], [3], [2], [9]], np.uint64))
    assert "".join(str(int(x)) for x in trie.bits) == "110" "110" "0" "10" "0" "0"
    assert trie.parents().tolist() == [-1, -1, 0, 0, 2] and trie.children().tolist() == [2, 0, 1, 0, 0]
    assert trie.labels[:, 0].tolist() == [1, 9, 2, 3, 4]
    assert trie.rolled_up(np.ones(5, np.int64)).tolist() == [4, 1, 2, 1, 1]


def test_query(spark, sf):
    found = queries.op11_prefix_trie(spark, sf)
    rows = set(map(tuple, found.collect()))
    assert rows == brute([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    assert set(duckdb.sql(queries.oracle_sql()["op11_prefix_trie"]).select(", ".join(found.columns)).fetchall()) == rows
