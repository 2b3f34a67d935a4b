import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm import anchors, queries, suffix_dedup
from meterlake.llm.suffix_array import neighbours_alike, suffix_array
from meterlake.llm.suffix_dedup import repeated_spans, without
from pyspark.sql import functions as F


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 3))
def test_suffix_array(symbols, times):
    s = [*symbols * times, 0]
    order = suffix_array(np.array(s))
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    room = np.arange(len(s))[::-1]
    shared = lambda a, b: next((k for k in range(9) if s[a + k : a + k + 1] != s[b + k : b + k + 1] or room[a] <= k or room[b] <= k), 9)
    place = np.argsort(order)
    want = [max((shared(i, order[p]) for p in (place[i] - 1, place[i] + 1) if 0 <= p < len(s)), default=0) for i in range(len(s))]
    assert neighbours_alike(np.array(s), order, room, 9).tolist() == want


def test_suffix_array_of_one_long_run():
    for text in (b"a" * 5000, b"ab" * 2500, bytes(range(1, 200)) * 30):
        s = np.append(np.frombuffer(text, np.uint8), 0).astype(np.int32)
        order = suffix_array(s)
        ranks = np.argsort(order)
        # each suffix follows the one before by its first symbol, or by what comes after
        a, b = order[:-1], order[1:]
        assert np.all((s[a] < s[b]) | ((s[a] == s[b]) & (ranks[np.minimum(a + 1, len(s) - 1)] < ranks[np.minimum(b + 1, len(s) - 1)])))


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        out.append((len(b), list(zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True)), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def held(spark, texts, window, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = repeated_spans(docs, ("doc_id", "text"), window=window, **kw).withColumn("kept", without(F.col("text"), F.col("spans"))).collect()
    assert len(found) == len(texts)
    want = brute(texts, window)
    for r in found:
        n, spans, kept = want[r.doc_id]
        assert (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) == (n, spans, kept)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def similar_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé d") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(5))]
        text = "".join(parts)
        for _ in range(rng.randrange(3)):
            if text:
                at = rng.randrange(len(text))
                text = text[:at] + "#" + text[at + 1 :]
        out.append(text)
    return out + ["a" * 700, "ab" * 300, "ab" * 100 + "c", "abc" * 200, None, "", passages[0], passages[0]]


def test_similar_texts(spark):
    held(spark, similar_texts(1), 200)


def test_other_windows(spark):
    held(spark, similar_texts(2), 40, step=8)
    with pytest.raises(ValueError):
        repeated_spans(spark.createDataFrame([(1, "a")], "doc_id long, text string"), step=57)


def test_large_cores_are_split(spark):
    rng = random.Random(5)
    own = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    core = "the passage that all of these texts share, " * 5
    texts = [own(rng.randrange(80)) + core[: rng.randrange(150, len(core))] + own(rng.randrange(80)) for _ in range(90)]
    held(spark, texts + texts[:3], 200, many=4)
    held(spark, similar_texts(4, 30), 90, many=1, step=4)


def test_pieces_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "BLOCK_SYMBOLS", 50)
    texts = similar_texts(7, 30)
    import pyarrow as pa

    # workers don't see what is patched here: the same calls, in this process
    pieces = [(row, at, len(t.buf)) for row, at, t in suffix_dedup._in_pieces(pa.array(["".join(x or "" for x in texts)]), 200)]
    assert len(pieces) > 5 and all(n <= 699 for _, _, n in pieces)
    text = pa.array(["".join(x or "" for x in texts)])
    cut, whole = {}, {}
    for found, column in ((cut, list(suffix_dedup._anchored(200)(iter([pa.record_batch([pa.array([1]), text], ["uid", "text"])])))), (whole, None)):
        if column is None:
            monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1 << 20)
            column = list(suffix_dedup._anchored(200)(iter([pa.record_batch([pa.array([1]), text], ["uid", "text"])])))
        for batch in column:
            for _, h, place, most, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for d in range(least, most + 1):
                    assert found.setdefault(place - d, (h, place)) == (h, place)
    assert cut == whole and len(whole) == len(text[0].as_py().encode()) - 199


def test_least_of_runs():
    rng = np.random.default_rng(2)
    for n in (5, 17, 100):
        v = rng.integers(0, 50, n).astype(np.uint64)
        assert anchors._least(v, 5).tolist() == [min(v[i : i + 5]) for i in range(n - 4)]


def test_odd_documents(spark, odd_docs):
    found = repeated_spans(odd_docs, ("doc_id", "ids")).collect()
    assert sorted((r.n_bytes, r.kept_sha256) for r in found) == sorted((n, hashlib.sha256(k).hexdigest()) for n, _, k in brute([r.text for r in odd_docs.collect()], 200))
    assert repeated_spans(odd_docs.limit(0)).collect() == []
    assert repeated_spans(odd_docs.where("text IS NULL")).count() == 1


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for r, (n, s, k) in zip(docs, brute([r.text for r in docs], 200), strict=True)}
    assert set(map(tuple, queries.op12_suffix_array_dedup(spark, sf).collect())) == want
    assert any(r[3] > 1 for r in want)
