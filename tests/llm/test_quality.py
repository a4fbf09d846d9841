import re
from collections import Counter

import pyarrow as pa
from llm_texts import DOCS, colliding, prose

from dataward.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    w = WORD.findall(text or "")
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_measures():
    texts = [None, "", "a", "a b c a b c a", "x\n x\nx\n\n\n", "é & é & é", "a\x0bb\x1cc d", "\n", prose(1, 500),
             "same line here\nsame line here", "z " * 300,
             "\n".join(colliding()), " ".join(colliding())]
    got = quality.measure(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == expected(text), text


def test_every_row_is_judged(messy, nothing):
    rows = quality.verdicts(messy).collect()
    texts = {r["doc_id"]: r["text"] for r in messy.filter("doc_id NOT IN (3, 10)").collect()}
    assert len(rows) == messy.count()
    for r in rows:
        if r["doc_id"] in texts:
            want = expected(texts[r["doc_id"]])
            assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.verdicts(nothing).count() == 0


def test_fences_follow_the_group(spark):
    clean = [(i, prose(i, 120), "en", "a", None) for i in range(40)]
    odd = [(100, " ".join(w + "###" for w in prose(100, 120).split()), "en", "a", None),
           (101, "\n".join(["Loremipsum dolor"] * 3 + [prose(101, 80)]), "en", "a", None)]
    # in a source where everybody writes so, symbols are no reason to reject
    usual = [(200 + i, " ".join(w + "###" for w in prose(200 + i, 120).split()), "en", "code", None) for i in range(40)]
    rows = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(clean + odd + usual, DOCS)).collect()}
    assert not rows[100]
    assert all(rows[i] for i in range(40))
    assert all(rows[200 + i] for i in range(40))


def test_sketch_does_not_depend_on_partitions(spark, messy):
    one = quality.sketch(quality.measured(messy.coalesce(1).select("lang", "source", "text"), ["lang", "source"]))
    many = quality.sketch(quality.measured(messy.repartition(9).select("lang", "source", "text"), ["lang", "source"]))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_filter_keeps_columns(messy, nothing):
    kept = quality.keep_good(messy)
    assert kept.columns == messy.columns and kept.dtypes == messy.dtypes
    good = sorted(str(r["doc_id"]) for r in quality.verdicts(messy).filter("kept").collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == good
    assert quality.keep_good(nothing).count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = ["__kept", "__base_failed", "__text", "__n_words", "__lang", "__source", "other0", "kept"]
    df = spark.createDataFrame([(1, prose(1, 90), "en", "a", *range(8)), (2, "short", "en", "a", *range(8))],
                               ["doc_id", "text", "lang", "source", *names])
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert [tuple(r) for r in kept.collect()] == [tuple(r) for r in df.filter("doc_id = 1").collect()]
