import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dataward.llm import topk


def brute(rows, k):
    """rows: (id, vector); the result of the contract."""
    ok = [(i, v) for i, v in rows if i is not None and v is not None
          and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 50:
            continue
        q = [math.floor(256 * x) for x in q]
        found = sorted((-sum(x * math.floor(256 * y) for x, y in zip(q, v)), j)
                       for b, (j, v) in enumerate(ok) if b != a and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def search(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows],
                               "vec_id bigint, embedding array<float>, label string, block int").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, **settings).select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [float(np.float32(r.uniform(-1, 1))) for _ in range(6)]) for i in range(260)]
    rows += [(1000 + i, rows[0][1]) for i in range(8)]              # ties
    rows += [(50, rows[1][1]), (50, rows[50][1])]                   # ids used again
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6),
             (None, rows[3][1]), (2200, []), (2250, [0.5, 0.25])]
    assert search(spark, rows) == brute(rows, 5)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    r = random.Random(4)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(150)]
    assert search(spark, rows) == brute(rows, 5)


def test_few_and_none(spark):
    assert search(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]
    assert search(spark, [(0, [1.0])]) == []
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(1, 5), st.integers(1, 6), st.integers(0, 9))
def test_threshold_stops_late_enough(n, dim, spread, seed):
    r = np.random.default_rng(seed)
    rows = r.integers(-spread, spread + 1, (n, dim))
    ids = r.permutation(n)
    best, score = topk.threshold_search(rows[:3], rows, ids, 4, np.arange(min(3, n)))
    for q in range(min(3, n)):
        want = sorted((-int(rows[q] @ rows[j]), int(ids[j])) for j in range(n) if j != q)[:4]
        assert [(-int(s), int(ids[b])) for b, s in zip(best[q], score[q]) if b >= 0] == want
