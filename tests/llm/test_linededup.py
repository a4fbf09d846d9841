import hashlib
import random
import re

from llm_texts import DOCS, prose

from dataward.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]")


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows):
    """rows: (doc_id, text), doc_ids different; kept text of each."""
    seen, out = [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if text is None:
            out[doc] = None
            continue
        kept = []
        for line in text.split("\n"):
            if not WORD.search(line):
                kept.append(line)
                continue
            long = len(line) >= linededup.FUZZY
            if not any(line == o or (long and len(o) >= linededup.FUZZY and within_one(line, o)) for o in seen):
                kept.append(line)
            seen.append(line)
        out[doc] = "\n".join(kept)
    return out


def edited(r, line):
    i = r.randrange(len(line))
    return r.choice([line[:i] + line[i + 1:], line[:i] + r.choice("xyé ") + line[i + 1:], line[:i] + r.choice("ab") + line[i:]])


def test_against_brute_force(spark):
    r = random.Random(5)
    pool = [prose(k, r.randint(1, 40), 99) for k in range(40)] + ["a" * 40, "a" * 41, "ab" * 33, "ab" * 32 + "a", "é" * 64]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(r.randint(0, 9)):
            line = r.choice(pool)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                line = edited(r, line) if len(line) > 1 else line
            lines.append(r.choice([line, line, "", " \t", "short"]))
        rows.append((doc * 3, "\n".join(lines)))
    rows += [(999, None), (None, pool[0] + "\nlast line of all, with a null id")]
    df = spark.createDataFrame([(*x, "h") for x in rows], "doc_id bigint, text string, h1 string").repartition(4)
    got = {x["doc_id"]: x for x in linededup.digests(df).collect()}
    assert len(got) == len(rows)
    for doc, text in brute(rows).items():
        before = dict(rows)[doc]
        assert got[doc]["n_lines"] == (0 if before is None else before.count("\n") + 1)
        want = None if text is None else hashlib.sha256(text.encode()).hexdigest()
        assert got[doc]["kept_sha256"] == want, (doc, before, text)


def test_edges_of_blocks(spark):
    """One edit at every place of lines whose lengths lie around multiples of the block."""
    r = random.Random(6)
    rows = []
    for n in (20, 31, 32, 33, 63, 64, 65, 96, 130):
        base = "".join(r.choice("abcdefgh") for _ in range(n))
        rows.append(base)
        rows += [base[:i] + "Z" + base[i + 1:] for i in range(n)] + [base[:i] + base[i + 1:] for i in range(n)]
        rows += [base[:i] + "Y" + base[i:] for i in range(n + 1)]
        firsts = len(rows)
        assert firsts
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    kept = {x["doc_id"] for x in linededup.digests(df).filter("n_removed = 0").collect()}
    bases = {i for i, t in enumerate(rows) if "Z" not in t and "Y" not in t and len(t) in (20, 31, 32, 33, 63, 64, 65, 96, 130)
             and (i == 0 or "Y" in rows[i - 1])}
    short = {i for i, t in enumerate(rows) if len(t) < linededup.FUZZY and rows.index(t) == i}
    assert kept == bases | short


def test_columns_and_empty_rows(messy, nothing):
    out = linededup.deduplicate(messy)
    assert out.dtypes == messy.dtypes
    rows = out.collect()
    assert not any(r["doc_id"] == 14 for r in rows)                 # all its lines stand in 13
    assert sum(r["doc_id"] == 3 for r in rows) == 0                 # equals 1
    assert {4, 5, 6} <= {r["doc_id"] for r in rows}                 # nothing in them to repeat
    for r in rows:
        if r["text"] is not None:
            assert r["n_chars"] == len(r["text"])
    assert linededup.deduplicate(nothing).count() == 0 and linededup.digests(nothing).count() == 0


def test_plan_is_native(spark):
    plan = linededup.digests(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_columns_of_any_name_pass_through(spark):
    names = ["__text", "__kept", "__lines", "__left", "__doc", "__content", "h1", "other0"]
    df = spark.createDataFrame([(1, "one line here that stays\nanother line", *range(8)),
                                (2, "one line here that stays\nits own line", *range(8))], ["doc_id", "text", *names])
    kept = linededup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [
        (1, "one line here that stays\nanother line", *range(8)), (2, "its own line", *range(8))]
