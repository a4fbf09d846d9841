import os
import zlib

import numpy as np
import pytest
from llm_texts import DOCS

from dataward.llm import langid

SF = "/root/testdata/sf0.01"


def test_suffix_automaton_holds_every_substring():
    text = np.array([2, 3, 2, 2, 3, 4, 2, 3, 2])
    size = 5
    table = langid.automaton([text, np.array([4, 4, 3])], size)

    def accepted(word):
        state = 0
        for c in word:
            step = table[state + c]
            if step & 1:
                return False
            state = step >> 1
        return True

    sources = [text.tolist(), [4, 4, 3]]
    for n in range(1, 5):
        for word in np.ndindex(*([3] * n)):
            word = [c + 2 for c in word]
            inside = any(s[i:i + n] == word for s in sources for i in range(len(s)))
            assert accepted(word) == inside, word


def test_parse_counts_longest_phrases():
    model = langid.Model({"a": ["abcabd"], "b": ["xyzxy"]})
    classes = model._squeeze(model.alphabet.read("abcabdab"))
    bits = model._bits_per_character(classes, np.array([0, len(classes)]))
    assert bits[0, 0] == pytest.approx(2 * model.bits[0] / 8)      # abcabd, ab
    assert model.predict(["abca", "XYZ", None, "12 !", "", "x" * 5000])[0] == ["a", "b", "und", "und", "und", "b"]


def test_edge_rows(spark, messy, nothing):
    rows = langid.identify(messy).collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in (4, 5, 6, 12):
            assert r["lang_pred"] == "und" and r["score"] == 0
    assert langid.identify(nothing).count() == 0
    untaught = spark.createDataFrame([(1, "some text", None, None, None)], DOCS)
    assert [r["lang_pred"] for r in langid.identify(untaught).collect()] == ["und"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    # no label, source or id of the row is looked at: other labels, same model, same answers
    model = langid.fit(docs)
    blind = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    swapped = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'q' AS source", "n_chars")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(swapped, model).collect()} == blind
