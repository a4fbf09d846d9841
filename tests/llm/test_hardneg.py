import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dataward.llm import hardneg

SCHEMA = "vec_id bigint, embedding array<float>, label int, dim string, block int, ref string, rank int"


def brute(rows, k=5):
    """rows: (id, vector, label); the result of the contract."""
    ok = [(i, [math.floor(256 * x) for x in v], (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows
          if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q, c) in enumerate(ok):
        if i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), j, d) for b, (j, v, d) in enumerate(ok) if b != a and len(v) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scored if s[2] == c][:k]:
            fits = [s for s in scored if s[2] != c and 80 * ps <= 100 * s[0] <= 100 * ps][:k]
            out += [(i, p, r + 1, j, ps, ns) for r, (ns, j, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "d", 1, "r", 2) for r in rows], SCHEMA).repartition(3)
    found = hardneg.hard_negatives(df, **settings)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def near(r, centre, spread):
    return [float(np.float32(x + r.uniform(-spread, spread))) for x in centre]


def table(seed, n, dim=6, groups=5):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(groups)]
    return [(i, near(r, r.choice(centres), 0.2), r.randint(0, 9)) for i in range(n)]


def test_against_brute_force(spark):
    rows = table(1, 420)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(9)]                  # ties, copies of an anchor
    rows += [(100, rows[1][1], 1), (100, rows[100][1], rows[100][2])]           # ids used again
    rows += [(2000, None, 1), (2100, [1.0] * 6, None), (2200, [float("nan")] * 6, 1), (2300, [1.0, None], 1),
             (None, rows[3][1], 1), (2400, [0.0] * 6, 2), (2500, [], 1), (2600, [0.5, 0.25], 1), (2601, [0.5, 0.2], 1),
             (2602, [0.5, 0.2], 2), (2700, [float("inf")] * 6, 3), (2800, [3e4] * 6, 4), (2801, [3e4] * 6, 5),
             (2802, [2.9e4] * 6, 4)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_small_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("ANCHORS", 2), ("TILE", 4), ("CARRIED", 1), ("REFERENCES", 3)):
        monkeypatch.setattr(hardneg, name, value)
    rows = table(2, 500, 4)
    assert mined(spark, rows) == brute(rows)


def test_driver_holds_no_copies_of_anchors(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    write = hardneg.materialize
    monkeypatch.setattr(hardneg, "materialize", lambda df, label: write(seen(df), label))
    df = spark.createDataFrame([(*r, "d", 1, "r", 2) for r in table(4, 300)], SCHEMA)
    seen(hardneg.hard_negatives(df))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_ranges_are_bounded(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("ANCHORS", 2), ("RANGES", 3), ("GROUPS", 2), ("HELD", 8)):
        monkeypatch.setattr(hardneg, name, value)
    dealt, frame = [], type(spark.range(0))
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, parts, *by: dealt.append(parts) or deal(df, parts, *by))
    rows = table(5, 700, 4)
    assert mined(spark, rows) == brute(rows)
    assert dealt and max(dealt) <= 3


def test_groups(spark):
    found = [hardneg._groups(spark, n) for n in (0, 1, 5, 100, 128 * hardneg.HELD, 1000 * hardneg.HELD)]
    assert found == [1, 1, 5, 8, 128, 1000]                # 8 shuffle partitions


def test_few_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (101, [1.0], 1)]) == []
    rows = [(100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 2), (103, [0.7], 2)]
    assert mined(spark, rows) == brute(rows) == [(100, 101, 1, 102, 65536, 58880)]


def block(r, number, n, dim, spread, directions):
    own = hardneg.Block.__new__(hardneg.Block)
    own.number, own.dim = number, dim
    own.data = r.integers(-spread, spread + 1, (n, dim)).astype(np.int64)
    own.ids, own.labels = r.permutation(n).astype(np.int64), r.integers(0, 3, n)
    own.norms, own.angles = hardneg.angles(own.data, directions)
    own.refs = own.angles.argmin(axis=1) if len(directions) else np.zeros(n, np.int64)
    own.owners, own.places = np.full(n, number), np.arange(n)
    return own


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 120), st.integers(1, 5), st.sampled_from([1, 4, 300, 10**6]), st.integers(0, 3), st.integers(0, 99))
def test_nothing_is_left_out(n, dim, spread, refs, seed):
    r = np.random.default_rng(seed)
    directions = r.normal(size=(refs, dim))
    directions /= np.linalg.norm(directions, axis=1)[:, None] if refs else 1
    rows = block(r, 7, n, dim, spread, directions)
    asking = block(r, 7 if seed % 2 else 8, min(n, 9), dim, spread, directions)
    if seed % 2:
        for name in ("data", "ids", "labels", "norms", "angles", "refs"):
            setattr(asking, name, getattr(rows, name)[:9])
    score = asking.data @ rows.data.T
    for same in (True, False):
        low, high = np.sort(r.choice(score.ravel(), (2, len(asking.ids), 2)), axis=0)
        got = {}
        for a, slot, row, value in zip(*hardneg.search(asking, rows, low.copy(), high, same, 3)):
            got.setdefault((int(a), int(slot)), []).append((-int(value), int(rows.ids[row]), int(row)))
        for a in range(len(asking.ids)):
            for slot in range(2):
                want = sorted((-int(score[a, j]), int(rows.ids[j]), j) for j in range(n)
                              if (asking.labels[a] == rows.labels[j]) == same and low[a, slot] <= score[a, j] <= high[a, slot]
                              and not (asking.number == 7 and a == j))[:3]
                assert sorted(got.get((a, slot), [])) == want


def test_bounds_hold():
    r = np.random.default_rng(3)
    directions = r.normal(size=(8, 12))
    directions /= np.linalg.norm(directions, axis=1)[:, None]
    data = r.integers(-300, 300, (400, 12))
    data = np.concatenate([data, data * 3, -data, data + r.integers(-1, 2, data.shape)])
    norm, angle = hardneg.angles(data, directions)
    for a in range(60):
        low = np.abs(angle - angle[a]).max(axis=1)
        high = np.minimum(angle + angle[a], 2 * math.pi - angle - angle[a]).min(axis=1)
        least, most = hardneg.score_bounds(low, high, norm[a], norm, norm)
        score = data @ data[a]
        assert (least <= score).all() and (score <= most).all()
