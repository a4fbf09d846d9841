"""Quality rules with adaptive thresholds.

Every text is measured once (vectorised, Arrow batches). Per language and source the
measures go into a mergeable quantile sketch with a bounded relative error: a count per
logarithmic bin, merged by addition, so the result does not depend on task order or on
the number of partitions. Quartiles read from the sketch give each group's fences,
which are joined back to the measures.

Defined results. Null or word-less text: zero measures, fails the base rule. Null
language or source: a group of its own. Repeated rows are judged alike and each is
returned. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataward.llm.words import SpanHashes, Texts, aside, mix, slices
from dataward.session import materialize

MIN_WORDS = 50              # base rule: fewer words fail
MAX_REPEAT_PERCENT = 50     # base rule: more repeated words fail
GAMMA = 1.02                # ratio of a bin's bounds: quantiles are within 1 %
SMALLEST = 1e-4             # smaller values share the zero bin
SPREAD = 4.0                # fences lie this many interquartile ranges outside the quartiles
# measure -> (fenced below, fenced above, least distance of a fence from its quartile)
RULES = {
    "word_length": (True, True, 2.0),
    "symbols_per_word": (False, True, 0.1),
    "dup_lines_per_word": (False, True, 0.05),
    "repeat_share": (False, True, 0.3),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of the keys, and which of the sorted keys equal their predecessor."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    return order, same


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The five base measures of each text."""
    t = Texts(texts)
    hashes = t.byte_hashes()
    start, end, doc = t.lines()
    words_before = np.concatenate([[0], np.cumsum(t.is_word)])
    filled = words_before[end] > words_before[start]
    start, end, doc = start[filled], end[filled], doc[filled]
    order, same = _repeats(mix(hashes.of(start, end) + mix(doc)))
    dup_lines = np.bincount(doc[order][same], minlength=t.n)
    words = hashes.of(t.start, t.end)
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        at = np.flatnonzero(t.doc[2:] == t.doc[:-2])
        keys = mix(SpanHashes(words, 0xC2B2AE3D27D4EB4F).of(at, at + 3) + mix(t.doc[at]))
        order, same = _repeats(keys)
        again = same.copy()
        again[:-1] |= same[1:]
        hit = at[order[again]]
        for k in range(3):
            covered[hit + k] = True
    return {
        "n_words": t.counts,
        "word_chars": t.per_text(t.is_word & ((t.buf & 0xC0) != 0x80)),
        "n_symbols": t.per_text(_SYMBOL[t.buf]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(t.doc[covered], minlength=t.n),
    }


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and the five measures of every row."""
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
                       + [f"__{m} bigint" for m in MEASURES])
    # the text goes in under a name of its own, so that it may also be kept
    fed = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                values = measure(part.column("__text"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(values[m], pa.int64()) for m in MEASURES)],
                    names=[*keep, *(f"__{m}" for m in MEASURES)])

    return fed.mapInArrow(run, schema)


def _ratios() -> dict[str, Column]:
    counts = {"word_length": "__word_chars", "symbols_per_word": "__n_symbols",
              "dup_lines_per_word": "__n_dup_lines", "repeat_share": "__n_repeat_words"}
    return {name: F.try_divide(F.col(c), F.col("__n_words")) for name, c in counts.items()}


def base_failed() -> Column:
    return ((F.col("__n_words") < MIN_WORDS)
            | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words")))


def sketch(measures: DataFrame) -> DataFrame:
    """Counts per (lang, source, rule, bin) of the rows that pass the base rule."""
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), value.alias("value"))
                      for name, value in _ratios().items()])
    return (measures.filter(~base_failed())
            .select("lang", "source", F.inline(pairs))
            .withColumn("bin", F.when(F.col("value") < SMALLEST, F.lit(None)).otherwise(
                F.ceil(F.log("value") / math.log(GAMMA)).cast("int")))
            .groupBy("lang", "source", "rule", "bin").agg(F.count("*").alias("n")))


def fences(counts: DataFrame) -> DataFrame:
    """One row per (lang, source) with a low and a high fence for each rule. The windows
    run over bins, of which a group has a few thousand at most."""
    group = Window.partitionBy("lang", "source", "rule")
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bin")), F.lit(0.0))
    ranked = (counts.withColumn("upto", F.sum("n").over(group.orderBy(F.asc_nulls_first("bin"))))
              .withColumn("total", F.sum("n").over(group)).withColumn("value", value))
    quartile = {q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), F.col("value")))
                for q in (0.25, 0.75)}
    bounds = (ranked.groupBy("lang", "source", "rule")
              .agg(quartile[0.25].alias("q1"), quartile[0.75].alias("q3"))
              .withColumn("spread", SPREAD * (F.col("q3") - F.col("q1"))))
    picks = []
    for name, (below, above, least) in RULES.items():
        mine = F.col("rule") == name
        margin = F.greatest("spread", F.lit(least))
        if below:
            picks.append(F.max(F.when(mine, F.col("q1") - margin)).alias(f"__{name}_low"))
        if above:
            picks.append(F.max(F.when(mine, F.col("q3") + margin)).alias(f"__{name}_high"))
    return (bounds.groupBy("lang", "source").agg(*picks)
            .select(F.col("lang").alias("__lang"), F.col("source").alias("__source"),
                    *[f"__{n}_{side}" for n, (b, a, _) in RULES.items()
                      for side, on in (("low", b), ("high", a)) if on]))


def _inside() -> Column:
    """Null fences belong to groups in which no row passes the base rule."""
    ok = ~base_failed()
    for name, value in _ratios().items():
        below, above, _ = RULES[name]
        if below:
            ok = ok & (value >= F.col(f"__{name}_low"))
        if above:
            ok = ok & (value <= F.col(f"__{name}_high"))
    return F.coalesce(ok, F.lit(False))


def judged(measures: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds `__base_failed` and `__kept`; the fences (one row per group) are joined on."""
    return (measures.join(bounds, F.col("lang").eqNullSafe(F.col("__lang"))
                          & F.col("source").eqNullSafe(F.col("__source")), "left")
            .withColumn("__base_failed", base_failed())
            .withColumn("__kept", _inside()))


def verdicts(docs: DataFrame) -> DataFrame:
    """Measures and verdict per row of `docs` (doc_id, text, lang, source)."""
    rows = materialize(measured(docs.select("doc_id", "text", "lang", "source"),
                                ["doc_id", "lang", "source"]), "quality")
    return judged(rows, fences(sketch(rows))).select(
        "doc_id", *[F.col(f"__{m}").alias(m) for m in MEASURES],
        F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with all their columns. Texts are measured twice, once
    for the thresholds and once for the filter, so that none has to be shuffled."""
    plain, back = aside(docs, ["lang", "source", "text"])
    rows = materialize(measured(plain.select("lang", "source", "text"), ["lang", "source"]), "quality")
    return back(judged(measured(plain, plain.columns), fences(sketch(rows))).filter("__kept"))
