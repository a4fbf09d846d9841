"""The pipeline's stages, one after the other, against brute force over the same documents."""

import math
import random
from collections import defaultdict

import corpus_pipeline
import test_linededup
import test_neardup
import test_packing
import test_quality
import test_substrdedup
from llm_texts import DOCS, prose, words

from dataward.llm import quality


def good(rows):
    """Quality verdicts, with quartiles of binned values computed by sorting."""
    measured = {r["doc_id"]: test_quality.expected(r["text"]) for r in rows}

    def ratios(m):
        n = m["n_words"]
        return {"word_length": m["word_chars"] / n, "symbols_per_word": m["n_symbols"] / n,
                "dup_lines_per_word": m["n_dup_lines"] / n, "repeat_share": m["n_repeat_words"] / n}

    def passes(m):
        return m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"]

    values = defaultdict(list)
    for r in rows:
        if passes(measured[r["doc_id"]]):
            for rule, v in ratios(measured[r["doc_id"]]).items():
                top = 0.0 if v < quality.SMALLEST else quality.GAMMA ** math.ceil(math.log(v) / math.log(quality.GAMMA))
                values[r["lang"], r["source"], rule].append(top)
    kept = []
    for r in rows:
        m = measured[r["doc_id"]]
        ok = passes(m)
        for rule, v in (ratios(m) if ok else {}).items():
            ordered = sorted(values[r["lang"], r["source"], rule])
            q1, q3 = (ordered[math.ceil(q * len(ordered)) - 1] for q in (0.25, 0.75))
            below, above, least = quality.RULES[rule]
            margin = max(quality.SPREAD * (q3 - q1), least)
            ok = ok and not (below and v < q1 - margin) and not (above and v > q3 + margin)
        if ok:
            kept.append(r["doc_id"])
    return sorted(kept)


def corpus():
    r = random.Random(12)
    passage = " ".join(words(500, 80))
    texts = []
    for k in range(30):
        base = prose(k, r.randint(60, 300))
        texts += [base]
        if k % 5 == 0:
            texts += [base, test_neardup.varied(r, base, 1).replace("altered", "varied")]
        if k % 6 == 1:
            texts.append(prose(100 + k, 80) + "\n" + passage + " " + prose(200 + k, 70, 200))
        if k % 7 == 2:
            texts.append(" ".join(w + "&&&" for w in base.split()))
    texts += ["too short", "", None, "same words here " * 80, prose(900, 4000, 30)]
    return [{"doc_id": i, "text": t, "lang": "en", "source": "s" if i % 3 else None,
             "n_chars": len(t) if t is not None else None} for i, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    names = [n.split()[0] for n in DOCS.split(", ")]
    docs = spark.createDataFrame([tuple(r[n] for n in names) for r in corpus()], DOCS)
    outputs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.dtypes == before.dtypes
        outputs.append(({r["doc_id"]: r.asDict() for r in before.collect()}, docs.collect()))

    rows, out = outputs[0]
    assert sorted(r["doc_id"] for r in out) == good(list(rows.values()))
    rows, out = outputs[1]
    want = test_linededup.brute([(d, r["text"]) for d, r in rows.items()])
    assert {r["doc_id"]: r["text"] for r in out} == {d: t for d, t in want.items() if t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    rows, out = outputs[2]
    classes = test_neardup.brute([(d, r["text"]) for d, r in rows.items()])
    assert sorted(r["doc_id"] for r in out) == sorted(set(classes.values()))
    rows, out = outputs[3]
    removed = {d: gone for d, _, gone, _ in test_substrdedup.brute([(d, r["text"]) for d, r in rows.items()], 50)}
    left = {r["doc_id"]: len(r["text"].split()) for r in out}
    assert left == {d: n for d, r in rows.items() if (n := len(r["text"].split()) - removed[d])}
    assert any(removed.values())
    rows, out = outputs[4]
    test_packing.check(out, {d: [r["text"]] for d, r in rows.items()}, 2048)


def test_run(spark, tmp_path):
    names = [n.split()[0] for n in DOCS.split(", ")]
    spark.createDataFrame([tuple(r[n] for n in names) for r in corpus()], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {r["doc_id"] for r in rows} < {r["doc_id"] for r in corpus()}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
