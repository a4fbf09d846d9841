import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dataward.llm import prefixtrie

TURNS = "conv_id bigint, turn bigint, role string, text string, key int, upper string, n int"


def brute(rows):
    """rows: (conv_id, turn, role, text); the result of the contract."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(q, key=lambda t: t[:2])] for c, q in own.items()}
    made = {}
    for c, q in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + q[h:])
    members = defaultdict(list)
    for c, q in made.items():
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    total = {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        leaves = 0 if children[path] else 1
        for child in children[path]:
            leaves, saved = leaves + total[child][0], saved + total[child][1]
        total[path] = leaves, saved
    out = []
    for path, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if made[c] == path)))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children[path]),
                    *total[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "u", 2) for r in rows], TURNS).repartition(3)
    got = prefixtrie.nodes(prefixtrie.rebuilt(df))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def table(seed, convs, spread=3):
    r = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["é", "hello", "a b", "", None][:spread + 2])))
    return rows


def test_against_brute_force(spark):
    rows = table(1, [*range(0, 130), *range(201, 240), 500, 100000])
    rows += [(None, 0, "user", "x"), (700, None, "user", "first"), (700, 0, "user", "then"), (701, 5, None, None)]
    rows += [(c, 0, "user", "the same") for c in range(800, 1400)]          # a hot first turn, and copies
    assert found(spark, rows) == brute(rows)


def test_single_chains(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(300)] + [(2, t, "user", f"turn {t}") for t in range(7)]
    assert found(spark, rows) == brute(rows)


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "one") for c in range(901, 930)]                 # no first conversation of the group
    assert any(r[1] == 0 and r[-1] != prefixtrie.NOTHING for r in brute(rows))
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_packed_ids_of_several_rows(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "RUN", 20)
    rows = [(c, t, "user", "same") for c in range(0, 100) for t in range(2)]
    assert found(spark, rows) == brute(rows)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "FEW", 0)
    rows = table(2, range(0, 60), 1)
    assert found(spark, rows) == brute(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=7), min_size=1, max_size=25))
def test_double_array_holds_its_sequences(sequences):
    own = sorted(map(tuple, {tuple(s) for s in sequences}))
    ids = np.array([i for s in own for i in s], np.int64)
    off = np.cumsum([0, *map(len, own)])
    trie = prefixtrie.DoubleArray(ids, off)
    for s in own:
        state = np.zeros(1, np.int64)
        for i in s:
            state = trie.child(state, np.array([i]))
    places = np.flatnonzero(trie.check[:trie.top] >= 0)
    assert len(places) == len({s[:d] for s in own for d in range(len(s) + 1)})


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60))
def test_a_shard_alone(seed, n):
    """All nodes of one shard, with the upper ones folded, against their definition."""
    r = random.Random(seed)
    own = sorted({tuple(r.choice([b"a" * 32, b"b" * 32, b"c" * 32]) for _ in range(r.randint(0, 5))) for _ in range(n)})
    off = np.cumsum([0, *map(len, own)])
    keys = np.array([k for s in own for k in s], "S32")
    weight, low = np.arange(1, len(own) + 1), np.arange(len(own)) * 10
    rows = prefixtrie.shard_nodes(keys, np.full(len(keys), 2), off, weight, low, [str(i) for i in range(len(own))])
    prefixes = {s[:d] for s in own for d in range(len(s) + 1)}
    assert len(rows["conv_id"]) == len(prefixes)
    for d, c, members in zip(rows["depth"], rows["conv_id"], rows["n_convs"]):
        path = own[c // 10][:d]
        assert members == sum(int(w) for s, w in zip(own, weight) if s[:d] == path)
