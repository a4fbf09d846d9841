"""Removal of repeated and nearly repeated lines by a deletion-neighbourhood join.

A line goes if an earlier line of the corpus equals it or, for lines of `FUZZY` characters
or more, is within one edit of it (a character inserted, removed or replaced). Earlier
means: smaller doc_id, then smaller position.

Two lines within one edit share a variant with one character taken out, or one of them is
such a variant of the other. All variants of a line would be as many as its characters, so
two joins on hashed keys come first that lose no pair:

1. half keys: of two such lines, either the first or the last `half` characters agree;
2. block keys: outside the block of `BLOCK` characters with the edit, the text before it
   agrees from the front and the text after it from the back.

Only blocks that meet another line emit their variants, hashed with the two outer parts.
Lines that share a variant are linked, edit distance verifies the links, the earliest
line stays. Equal keys are never paired with each other: each row is compared with the
earliest of its group, and members of one variant and place are all within one edit.
Everything is DataFrame expressions.

Defined results. Blank lines always stay. Null text stays null. Null doc_ids come last.
Rows equal in doc_id and text are one document and get the same result; of different rows
with one doc_id, the line's position, then the text's hash decides. Empty table: no rows.
Other columns pass through `deduplicate` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dataward.llm.words import aside
from dataward.session import materialize

FUZZY = 20
BLOCK = 32
BITS = 24                   # size of the candidates' bitmap
_LAST = 9223372036854775807


def _half(n: Column) -> Column:
    """Length of a half key for lines of n characters; twice it is never more than n."""
    return 4 * F.floor(n / 8).cast("int")


def _suffix(n: Column, block: Column) -> Column:
    """How many characters behind the block agree from the back, for a variant of length n."""
    return BLOCK * F.floor(F.greatest(n - BLOCK * (block + 1), F.lit(0)) / BLOCK).cast("int")


def _worded(line: Column) -> Column:
    return line.rlike(r"[^ \t-\r]")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with the text's hash: (doc_id, content) is a document's key."""
    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("content"))


def lines(texts: DataFrame) -> DataFrame:
    """One row per line with a word, with a 128-bit hash of it."""
    return (texts.select("doc_id", "content", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .filter(_worded(F.col("line")))
            .select("doc_id", "content", "pos", "line", F.xxhash64("line").alias("h1"),
                    F.xxhash64(F.lit(11), "line").alias("h2")))


def first_lines(texts: DataFrame) -> DataFrame:
    """Each different line (h1, h2), its earliest place and its half keys."""
    n = F.length("line")
    sizes = F.array_distinct(F.array(_half(n), _half(n + 1)))
    ends = F.flatten(F.transform(sizes, lambda p: F.array(
        F.xxhash64(F.lit(1), p, F.col("line").substr(F.lit(1), p)),
        F.xxhash64(F.lit(2), p, F.col("line").substr(n - p + 1, p)))))
    halves = F.when(n >= FUZZY, ends)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos", "content")
    return (lines(texts).select("h1", "h2", order.alias("at"), halves.alias("halves"))
            .groupBy("h1", "h2").agg(F.min(F.struct("at", "halves")).alias("best"))
            .select("h1", "h2", "best.at.doc_id", "best.at.pos", "best.at.content", "best.halves"))


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that two different lines have."""
    return (rows.groupBy(*keys).agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
            .filter("low <> high").select(*keys))


def _candidates(first: DataFrame) -> DataFrame:
    """Hashes of lines that share a half key with another line."""
    halves = first.select("h1", F.explode("halves").alias("half"))
    return halves.join(_shared(halves, "half"), "half", "left_semi").select("h1").distinct()


def _bitmap(hashes: DataFrame) -> DataFrame:
    """A set of hashes as at most 2**(BITS - 6) words of 64 bits: never more than 4 MB."""
    return (hashes.select(_word(F.col("h1")).alias("word"), _bit(F.col("h1")).alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 70 - BITS)


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(63).cast("int"))


def _texts_of(candidates: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate lines with their text. A bitmap of their hashes, which has a fixed size,
    keeps nearly all other lines out of the shuffle; the join then decides."""
    wanted = first.join(candidates, "h1", "left_semi").select(
        "h1", "h2", F.col("doc_id").alias("doc"), F.col("pos").alias("at"), F.col("content").alias("own"))
    near = (lines(texts).withColumn("word", _word(F.col("h1")))
            .join(F.broadcast(_bitmap(candidates)), "word")
            .filter(F.col("bits").bitwiseAND(_bit(F.col("h1"))) != 0).drop("word", "bits"))
    return (near.join(wanted, ["h1", "h2"])
            .filter(F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("pos") == F.col("at"))
                    & (F.col("content") == F.col("own")))
            .dropDuplicates(["h1", "h2"])
            .select("h1", "h2", F.coalesce("doc", F.lit(_LAST)).alias("doc"), "pos", "line",
                    F.length("line").alias("n")))


def _variants(text: DataFrame) -> DataFrame:
    """Hashed variants of lines (h1, doc, pos, line, n): key, the place taken out (-1: none)."""
    n, block, size = F.col("n"), F.col("block"), F.col("size")
    blocks = (text.select("h1", "doc", "pos", "line", "n",
                          F.explode(F.array(n - 1, n)).alias("size"))
              .select("*", F.explode(F.sequence(F.lit(0), F.floor(size / BLOCK).cast("int"))).alias("block"))
              .select("*", _suffix(size, block).alias("tail"))
              .select("h1", "doc", "pos", "n", "size", "block",
                      F.xxhash64("size", "block", F.col("line").substr(F.lit(1), block * BLOCK),
                                 F.col("line").substr(n - F.col("tail") + 1, F.col("tail"))).alias("outer"),
                      F.col("line").substr(block * BLOCK + 1, n - F.col("tail") - block * BLOCK).alias("middle")))
    met = blocks.join(_shared(blocks, "outer"), "outer", "left_semi")
    whole = met.filter("size = n").select("h1", "doc", "pos", F.xxhash64("outer", "middle").alias("key"),
                                          F.lit(-1).alias("out"))
    here = F.least(F.lit(BLOCK - 1), F.length("middle") - 1)
    cut = (met.filter("size < n").filter(F.length("middle") > 0)
           .select("h1", "doc", "pos", "outer", "middle", F.explode(F.sequence(F.lit(0), here)).alias("out"))
           .select("h1", "doc", "pos", F.xxhash64("outer", F.concat(
               F.col("middle").substr(F.lit(1), F.col("out")),
               F.col("middle").substr(F.col("out") + 2, F.length("middle")))).alias("key"), "out"))
    return whole.union(cut)


def _earlier(variants: DataFrame) -> DataFrame:
    """(h1, other): lines and the earliest line that a variant links them to, if it is earlier."""
    order = F.struct("doc", "pos", "h1")
    key, place = Window.partitionBy("key"), Window.partitionBy("key", "out")
    is_whole = F.col("out") < 0
    linked = variants.select(
        "h1", order.alias("me"), is_whole.alias("whole"),
        F.when(~is_whole, F.min(order).over(place)).alias("replaced"),
        F.min(F.when(is_whole, order)).over(key).alias("shorter"),
        F.min(F.when(~is_whole, order)).over(key).alias("longer"))
    partner = F.when(F.col("whole"), F.col("longer")).otherwise(
        F.least("replaced", F.coalesce("shorter", "replaced")))
    return (linked.select("h1", "me", partner.alias("other")).filter(F.col("other") < F.col("me"))
            .select("h1", F.col("other.h1").alias("other")).distinct())


def dropped(texts: DataFrame, first: DataFrame) -> DataFrame:
    """Different lines (h1, h2) that have an earlier line within one edit."""
    candidates = materialize(_candidates(first), "line_candidates")
    picked = materialize(_texts_of(candidates, first, texts), "line_texts")
    links = _earlier(_variants(picked))
    own = picked.select("h1", "h2", "line")
    pairs = links.join(own, "h1").join(own.select(F.col("h1").alias("other"), F.col("line").alias("earlier")), "other")
    return pairs.filter(F.levenshtein("line", "earlier", 1) >= 0).select("h1", "h2").distinct()


def _kept(docs: DataFrame) -> DataFrame:
    """For each document that keeps lines: its key and their positions."""
    texts = keyed(docs)
    first = materialize(first_lines(texts), "first_lines")
    return (first.join(dropped(texts, first), ["h1", "h2"], "left_anti")
            .groupBy(F.col("doc_id").alias("__doc"), F.col("content").alias("__content"))
            .agg(F.collect_set("pos").alias("__kept")))


def _with_kept(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with `__lines` and `__left`, the kept and the blank lines in order;
    `__kept` is null where every line with a word goes."""
    lined = F.split("text", "\n")
    blank = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: ~_worded(F.get("__lines", i)))
    places = F.array_sort(F.array_union(F.coalesce("__kept", F.array().cast("array<int>")), blank))
    left = F.when(F.size(places) == F.size("__lines"), F.col("__lines")).otherwise(
        F.transform(places, lambda i: F.get("__lines", i)))
    return (docs.join(_kept(docs.select("doc_id", "text")), F.col("doc_id").eqNullSafe(F.col("__doc"))
                      & (F.xxhash64("text") == F.col("__content")), "left")
            .withColumn("__lines", lined).withColumn("__left", left))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, number of lines, number removed and the SHA-256 of the text left, per row."""
    size = F.coalesce(F.size("__lines"), F.lit(0))
    return _with_kept(docs.select("doc_id", "text")).select(
        "doc_id", F.greatest(size, F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(size - F.size("__left")).cast("bigint").alias("n_removed"),
        F.when(F.col("text").isNotNull(), F.sha2(F.array_join("__left", "\n").cast("binary"), 256)).alias("kept_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """`docs` without repeated lines. Rows whose lines with words are all gone go; `n_chars`,
    where there is such a column, follows the text."""
    plain, back = aside(docs, ["doc_id", "text", "n_chars"])
    left = F.when(F.col("text").isNotNull(), F.array_join("__left", "\n"))
    rows = (_with_kept(plain).filter(F.col("text").isNull() | ~_worded(F.col("text")) | F.col("__kept").isNotNull())
            .withColumn("__text", left))
    if "n_chars" in plain.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__text") == F.col("text"), F.col("n_chars"))
                               .otherwise(F.length("__text")).cast(docs.schema["n_chars"].dataType))
    return back(rows.withColumn("text", F.col("__text")))
