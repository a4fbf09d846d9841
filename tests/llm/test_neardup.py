import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import prose, words
from pyspark.sql import functions as F

from dataward.llm import components, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or (Counter([tuple(w)]) if w else None)


def brute(rows, least=0.8):
    """rows: (doc_id, text), doc_ids different: class of each by plain similarity."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(d for d in sets if sets[d])
    for i, a in enumerate(docs):
        for b in docs[:i]:
            least_sum = sum((sets[a] & sets[b]).values())
            if least_sum >= least * sum((sets[a] | sets[b]).values()):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def varied(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(["altered", "changed", "other"])
    return " ".join(w)


def corpus():
    """Pairs well above or well below the threshold, one star whose leaves are not alike."""
    r = random.Random(8)
    rows = []
    for k in range(12):
        base = " ".join(words(k, 200))
        rows += [base, base, varied(r, base, 1), varied(r, base, 2), varied(r, base, 40)]
    centre = " ".join(words(99, 400))
    rows += [centre] + [varied(r, centre, 6) for _ in range(25)]
    rows += ["one two", "one two", "", None, "three", prose(5, 3000)]
    return list(enumerate(rows))


def classes(spark, rows):
    df = spark.createDataFrame([(*x, "n") for x in rows], "doc_id bigint, text string, node string").repartition(4)
    return {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}


def test_against_brute_force(spark):
    rows = corpus()
    assert classes(spark, rows) == brute(rows)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "PER_SALT", 3)
    rows = corpus()
    assert classes(spark, rows) == brute(rows)


def one_bucket(monkeypatch):
    """All texts share one bucket, where members come in the order of their digests."""
    monkeypatch.setattr(neardup, "signatures", lambda docs, factor: docs.select(
        "doc_id", neardup._node().alias("node"), F.array(F.lit(1).cast("bigint")).alias("bands")))


def placed(text, place):
    """The text with one more word, so that its digest starts with the two digits."""
    return next(t for t in (f"{text} end{k}" for k in range(100_000)) if hashlib.md5(t.encode()).hexdigest()[:2] == place)


def test_links_beside_the_pivots_class(spark, monkeypatch):
    """A pivot that is like only some, a member between it and others, and strangers."""
    one_bucket(monkeypatch)
    monkeypatch.setattr(neardup, "SMALL", 1)
    w = words(1, 400)
    first, last = ["changed"] * 40 + w[40:], w[:-40] + ["other"] * 40
    rows = [placed(" ".join(first), "00"), placed(" ".join(w), "f0"),
            placed(" ".join(last), "10"), placed(" ".join(last), "11")]
    for k, places in ((2, ("20", "21")), (3, ("30", "31"))):
        rows += [placed(" ".join(words(k, 400)), p) for p in places]
    rows = list(enumerate(rows))
    assert len(set(brute(rows).values())) == 3
    assert classes(spark, rows) == brute(rows)


def test_clusters_that_share_a_bucket(spark, monkeypatch):
    one_bucket(monkeypatch)
    rows = [placed(" ".join(words(k, 60)), f"{10 * k + i}") for k in (1, 2) for i in range(4)]
    rows += [placed(" ".join(words(k, 60)), f"d{k}") for k in (4, 5)]
    rows += [placed(" ".join(words(3, 60)), f"e{i}") for i in range(4)]
    rows = list(enumerate(rows))
    assert len(set(brute(rows).values())) == 5
    assert classes(spark, rows) == brute(rows)


def copies(seed, n, size, changed):
    r = random.Random(seed)
    base = words(seed, size)
    rows = []
    for k in range(n):
        w = list(base)
        for i in r.sample(range(size), changed):
            w[i] = f"new{k}x{i}"
        rows.append(" ".join(w))
    return rows


def compared(spark, monkeypatch, rows):
    """Classes and the number of compared pairs."""
    counts, verified = [], neardup.verified

    def counting(pairs, *args):
        counts.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(neardup, "verified", counting)
    return classes(spark, list(enumerate(rows))), sum(counts)


def test_a_group_that_is_not_alike_enough_is_not_compared_pairwise(spark, monkeypatch):
    found, few = compared(spark, monkeypatch, copies(3, 100, 400, 9))
    assert len(set(found.values())) == 100
    found, many = compared(spark, monkeypatch, copies(3, 400, 400, 9))
    assert len(set(found.values())) == 400
    assert many < 8 * few and many < 400 * 399 / 6


def test_a_group_of_near_copies_is_one_class(spark, monkeypatch):
    found, pairs = compared(spark, monkeypatch, copies(4, 200, 400, 4))
    assert len(set(found.values())) == 1 and pairs < 200 * 60


def test_pairs_within_a_large_group_that_is_not_alike(spark):
    """Each text of a group of strangers to each other has one near copy."""
    rows = [t for text in copies(5, 120, 400, 12) for t in (text, text.replace("new", "now", 1))]
    found = classes(spark, list(enumerate(rows)))
    want = brute(list(enumerate(rows)))
    assert len(set(want.values())) == 120
    assert sum(found[d] == want[d] for d in want) >= 0.97 * len(rows)


def partners(seed, n):
    """A group of texts that are not alike enough, each with one partner a little above the bound."""
    rows = []
    for k, text in enumerate(copies(seed, n, 400, 8)):
        w = text.split(" ")
        rows += [text, " ".join(w[:5 * k % 360] + [f"own{k}x{i}" for i in range(30)] + w[5 * k % 360 + 30:])]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [2048, 30])
def test_a_bucket_of_any_size_loses_no_link(spark, monkeypatch, block):
    one_bucket(monkeypatch)
    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    monkeypatch.setattr(neardup, "OUTSIDERS", 0, raising=False)     # no short cut for the few, if there is one
    rows = partners(6, 90)
    want = brute(rows)
    assert len(set(want.values())) == 90
    assert classes(spark, rows) == want


def test_sums_of_minima_by_blocks(monkeypatch):
    r = np.random.default_rng(5)
    factor = r.uniform(1, 1.1, neardup.FEATURES)
    texts = []
    for _ in range(25):
        value = np.unique(np.append(r.choice(300, 40), r.choice(2**31, 30))).astype(np.uint32)
        texts.append((value, r.integers(1, 6, len(value)).astype(np.uint32)))
    x, y = texts[:15], texts[5:]
    for frequent, pairs, columns in ((100, 1 << 21, 1024), (1, 7, 16), (3, 50, 3)):
        monkeypatch.setattr(neardup, "FREQUENT", frequent)
        monkeypatch.setattr(neardup, "PAIRS", pairs)
        monkeypatch.setattr(neardup, "COLUMNS", columns)
        found = neardup._least_sums(x, y, factor)
        for i, (v, c) in enumerate(x):
            for j, (w, d) in enumerate(y):
                mine, other = (dict(zip(a.tolist(), neardup.weights(a, b, factor))) for a, b in ((v, c), (w, d)))
                assert found[i, j] == pytest.approx(sum(min(mine[k], other[k]) for k in mine.keys() & other.keys()))


def test_links_of_a_block_join_what_all_links_join():
    r = np.random.default_rng(7)
    for _ in range(20):
        linked = r.random((12, 9)) < 0.1
        x, y = r.integers(0, 15, 12), r.integers(0, 15, 9)
        found = neardup._forest(linked, x, y)

        def joined(links):
            root = list(range(15))
            for i, j in links:
                root = [root[x[i]] if k == root[y[j]] else k for k in root]
            return {tuple(a for a in range(15) if root[a] == k) for k in root}

        assert joined(found) == joined(np.argwhere(linked).tolist()) and len(found) == 15 - len(joined(found))


def test_samples_estimate_weighted_similarity():
    r = np.random.default_rng(2)
    value = np.sort(r.choice(2**31, 600, replace=False)).astype(np.uint32)
    a, b = r.gamma(2, 1, 600), r.gamma(2, 1, 600)
    b[:400] = a[:400]
    hits = 0
    for k in range(40):                                  # other shingles, other draws
        shifted = value + np.uint32(k)
        keys = neardup.samples(np.repeat([0, 1], 600), np.concatenate([shifted, shifted]), np.concatenate([a, b]), 2)[1]
        hits += (keys[0] == keys[1]).sum()
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert hits / (40 * keys.shape[1]) == pytest.approx(true, abs=0.03)


def test_messy_rows(messy, nothing):
    rows = neardup.classes(messy).collect()
    assert len(rows) == messy.count()
    by = {r["doc_id"]: r["class_id"] for r in rows}
    assert by[2] == by[3] == 1 and by[4] == 4 and by[5] == 5 and by[6] == 6 and by[None] is None
    kept = neardup.one_of_each(messy)
    assert kept.dtypes == messy.dtypes
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and ids[4] == ids[5] == ids[6] == 1 and ids[None] == 1 and ids[10] == 2
    assert neardup.classes(nothing).count() == 0 and neardup.one_of_each(nothing).count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = ["__doc", "__node", "__once", "__copy", "__own", "node", "pivot", "other0", "a.b"]
    df = spark.createDataFrame([(1, prose(1, 40), *range(9)), (2, prose(1, 40), *range(9)), (3, prose(2, 40), *range(9))],
                               ["doc_id", "text", *names])
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in df.filter("doc_id <> 2").collect())


def test_ties_do_not_depend_on_the_order(spark):
    rows = [(1, prose(1, 40), k) for k in range(6)]
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "doc_id bigint, text string, low int").repartition(3)
        assert [r["low"] for r in neardup.one_of_each(df).collect()] == [0]


def test_one_row_of_equal_rows_stays(spark):
    df = spark.createDataFrame([(1, prose(1, 40), 1)] * 3 + [(2, prose(1, 40), 2), (3, None, 3), (3, None, 3)],
                               "doc_id bigint, text string, low int")
    assert sorted(r["doc_id"] for r in neardup.one_of_each(df).collect()) == [1, 3, 3]


def test_components(spark):
    r = random.Random(1)
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("x", "x"), ("y", "z")]
    edges += [(f"n{r.randrange(80)}", f"n{r.randrange(80)}") for _ in range(60)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert got == {v: find(v) for v in root if sum(v in e and e[0] != e[1] for e in edges)}


def test_frequencies_count_all_rows(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b c d e",), ("",), (None,), ("v w x y z a",)], "text string").repartition(3)
    found = neardup.document_frequencies(df)
    assert found[-1] == 5 and sorted(found[:-1][found[:-1] > 0].tolist()) == [1, 1, 2]
    assert (neardup.factors(found) >= 1).all() and (neardup.factors(found) <= 1 + neardup.DAMPING).all()
    assert len(neardup.shingles(neardup.Texts(pa.array([None, ""], pa.string())))[0]) == 0
