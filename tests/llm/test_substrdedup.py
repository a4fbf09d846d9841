import hashlib
import random
import re

import pyarrow as pa
import pytest
from llm_texts import words

from dataward.llm import substrdedup
from dataward.llm.words import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows: (doc_id, text): number of words, removed words and kept text of each row."""
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = {i + k for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i:i + window])] < d
                for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(window):
    r = random.Random(window)
    passages = [words(k, r.randint(window - 2, 3 * window)) for k in range(8)] + [["the"] * (3 * window), ["é", "b"] * window]
    rows = []
    for doc in range(50):
        w = []
        for _ in range(r.randint(0, 4)):
            w += r.choice(passages)[r.randint(0, 2):] if r.random() < 0.6 else words(1000 + r.randrange(10**6), r.randint(1, 60))
        rows.append((r.randrange(40), r.choice([" ", "\n", "  "]).join(w)))
    return rows + [(None, " ".join(passages[0])), (60, None), (61, ""), (62, " ".join(passages[0])), (62, " ".join(passages[0]))]


@pytest.mark.parametrize("window, hot", [(8, 2000), (8, 1), (50, 2000)])
def test_against_brute_force(spark, monkeypatch, window, hot):
    monkeypatch.setattr(substrdedup, "HOT", hot)
    rows = corpus(window)
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id bigint, text string, key string").repartition(4)
    got = sorted((tuple(r) for r in substrdedup.digests(df, window).collect()), key=repr)
    assert got == brute(rows, window)


def test_super_kmers_cover_every_window_once():
    r = random.Random(2)
    texts = [" ".join(r.choice("ab") for _ in range(900)), " ".join(words(1, 49)), " ".join(words(1, 50)), None,
             " ".join(words(2, 700))]
    doc, first, count, key = substrdedup.super_kmers(Texts(pa.array(texts, pa.string())))
    for d, text in enumerate(texts):
        n = len((text or "").split())
        windows = [f + k for f, c, x in zip(first, count, doc) if x == d for k in range(c)]
        assert windows == list(range(max(0, n - 49)))
    assert count.max() <= substrdedup.LONGEST
    assert len(first) < 0.2 * count.sum()


def test_text_left(spark, messy, nothing):
    passage = " ".join(words(3, 60))
    rows = [(1, f"start {passage}\nend", "en", 9), (2, f"own words\n{passage}  \n tail here", "en", 9), (3, passage, "en", 9),
            (4, "", "en", 0), (5, None, "en", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, first string, n_chars bigint")
    got = {r["doc_id"]: r for r in substrdedup.deduplicate(df).collect()}
    assert set(got) == {1, 2, 4, 5}                      # nothing is left of 3
    assert got[1]["text"] == rows[0][1] and got[1]["n_chars"] == 9
    assert got[2]["text"] == "own words\ntail here" and got[2]["n_chars"] == len(got[2]["text"])
    out = substrdedup.deduplicate(messy)
    assert out.dtypes == messy.dtypes and substrdedup.deduplicate(nothing).count() == 0
    assert len(substrdedup.digests(messy).collect()) == messy.count() and substrdedup.digests(nothing).count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = ["__marked", "__h1", "__h2", "__k1", "__k2", "__empty", "k1", "other0"]
    shared = " ".join(words(1, 60))
    df = spark.createDataFrame([(1, shared, *range(8)), (2, "begin " + shared, *range(8))], ["doc_id", "text", *names])
    kept = substrdedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, shared, *range(8)), (2, "begin", *range(8))]
