import math

import numpy as np
import pytest

from meterlake.llm import queries
from meterlake.llm.topk_search import _scores, _wide_scores, top_k

MOST, LEAST = (1 << 63) - 1, -(1 << 63)
SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank string"


def brute(rows, k=5, every=50, scale=256):
    """All pairs in Python's whole numbers."""
    limit = lambda n: max(LEAST, min(MOST, n))
    sound = [(i, [limit(math.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in sound:
        if i % every == 0:
            asked[i] = min(v, asked.get(i, v))
    out = set()
    for q, v in asked.items():
        near = sorted(((-limit(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in sound if i != q and len(w) == len(v)))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(near[:k], 1)}
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x", None) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in top_k(df, **kw).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_against_all_pairs(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in queries.op7_topk_search(spark, sf).collect()} == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [0.5, 9.0]), (50, None), (100, [1.0, None]), (150, [nan, 1.0]), (200, [1.0, -inf]), (None, [1.0, 1.0]), (250, [1.0, 2.0, 3.0]), (300, []), (301, []), (-50, [-1.0, 0.25])]
    rows += [(i, [1.0, 1.0]) for i in range(1, 9)] + [(3, [1.0, 1.0]), (9, [0.001, -0.001])]
    # repeated rows of a key are candidates of their own, with the same rank order as any ties
    got = found(spark, rows)
    best = lambda q: [(i, s) for _, _, i, s in sorted(x for x in got if x[0] == q)]
    assert {q for q, *_ in got} == {0, 300, -50}
    assert best(300) == [(301, 0)]
    assert [i for i, _ in best(0)] == [1, 2, 3, 3, 4]
    assert [s for _, s in best(-50)] == [s for _, _, _, s in sorted(x for x in brute(rows) if x[0] == -50)]
    assert found(spark, []) == set()
    assert found(spark, [(50, [1.0])]) == set()


@pytest.mark.parametrize("most", [1e7, 1e12, 1e15, 1e300])
def test_huge_components(spark, most):
    rng = np.random.default_rng(int(math.log10(most)))
    rows = [(i, (rng.choice([-1.0, 1.0, 0.5, 1e-9], 3) * most).tolist()) for i in range(101)]
    assert found(spark, rows) == brute(rows)


def test_wide_products_are_exact():
    rng = np.random.default_rng(6)
    q, c = (rng.integers(LEAST, MOST, (5, 300)) >> rng.integers(0, 60, (5, 300)) for _ in range(2))
    c[0] = -q[0]
    c[1, ::2], q[1, ::2] = MOST, LEAST
    c[2] = 0
    c[2, :2], q[2, :2] = (1 << 62, 1 - (1 << 62)), (4, 4)
    want = [[max(LEAST, min(MOST, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in c] for x in q]
    assert _wide_scores(q, c).tolist() == want == _scores(q, c).tolist()
