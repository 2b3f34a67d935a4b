import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm import queries
from meterlake.llm.fill_in_middle import PLAIN, Sentinels, fill_in_middle, restored
from pyspark.sql import functions as F


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def held(rows):
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.restored == (r.text or "")


def test_odd_documents(odd_docs):
    rows = fill_in_middle(odd_docs, ("doc_id", "text")).collect()
    assert len(rows) == odd_docs.count()
    held(rows)
    assert fill_in_middle(odd_docs.limit(0)).collect() == []


def test_columns_of_own_names(odd_docs):
    docs = odd_docs.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("output", "form", "_units", "_k0", "n")))
    assert fill_in_middle(docs, ("doc_id",)).count() == docs.count()
    assert fill_in_middle(docs, ("doc_id", "_k0")).select("_k0").distinct().collect() == [(1,)]


def test_sentinels_and_code_points(spark):
    texts = ["<P>", "a<S>b", "<M", "<P<S", "P>x", "<", ">", "<<>>P>", "\U0001f600é日x" * 9, "\r\n \x00 \n", "é" * 40, "$1\\E\\Q[", "\udbff".encode("utf8", "ignore").decode()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "doc_id long, text string")
    rows = fill_in_middle(docs, ("doc_id", "text")).collect()
    held(rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(st.sampled_from("<>PSMa é\n\U0001f600"), max_size=14), min_size=1, max_size=60))
def test_any_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held(fill_in_middle(docs, ("doc_id", "text")).collect())


def test_broken_outputs_are_not_restored(spark):
    rows = [("<S>a<P>b<M>c", "psm"), ("<P>a<S>b", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c<M>", "psm"), ("<P>a<S>b<M>c", "spm"), (None, "psm"), ("<P>", PLAIN)]
    df = spark.createDataFrame(rows, "output string, form string")
    assert [r[0] for r in df.select(restored(F.col("output"), F.col("form"))).collect()] == [None] * 6 + ["<P>"]


def test_own_sentinels(spark):
    marks = Sentinels("<|pre|>", "<|suf|>", "<|mid|>")
    docs = spark.createDataFrame([(i, "some text <P> of its own") for i in range(40)], "doc_id long, text string")
    rows = fill_in_middle(docs, marks=marks).collect()
    assert all(r.restored == "some text <P> of its own" for r in rows) and sum(r.form != PLAIN for r in rows) > 20
    with pytest.raises(ValueError):
        Sentinels("<P>", "<P>", "<M>")
    with pytest.raises(ValueError):
        Sentinels("P>")


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(d, *brute(d, t)[:4], sha(brute(d, t)[4]), sha(t or "")) for d, t in docs}
    found = queries.op13_fill_in_middle(spark, sf)
    assert set(map(tuple, found.collect())) == want
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cursor = duckdb.sql(queries.oracle_sql()["op13_fill_in_middle"])
    assert set(cursor.select(", ".join(found.columns)).fetchall()) == want
