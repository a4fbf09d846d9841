"""Removal of repeated passages by super-k-mer partitioning.

A window is `WINDOW` consecutive words. Its minimiser is the smallest hash among its runs
of `SEED` words, so equal windows have equal minimisers, and neighbouring windows mostly
share one: such a stretch is a super-k-mer.

1. Texts give super-k-mer descriptors (minimiser, document, place), without their words.
2. Only minimisers met in two documents can hold a shared window; the others stop here.
3. The remaining super-k-mers travel as one packed string of words to their minimiser's
   bucket, which sorts its windows and finds the smallest document of each. Windows of a
   minimiser met more than `HOT` times travel alone, as digests that are combined before
   the shuffle, so no bucket is larger than that.
4. Each document's windows that start in a smaller document mark their words.

Defined results. Null text: no words. A null doc_id is not compared: its row stays whole.
Repeated doc_ids are not smaller than each other; rows equal in doc_id and text are one
document and get the same result. Documents of fewer than `WINDOW` words stay. Empty table:
no rows. Other columns, whatever their names, pass through `deduplicate` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm.words import SpanHashes, Texts, aside, slices
from dataward.session import materialize

WINDOW = 50
SEED = 6                    # words whose hash may become a minimiser
LONGEST = 256               # most windows in one super-k-mer
HOT = 20_000                # more super-k-mers than this (100 MB), and a minimiser's windows travel alone
_SEED_BASE = 0xA24BAED4963EE407 | 1
_NONE = np.uint64(2**64 - 1)


def super_kmers(t: Texts, window: int = WINDOW, seed: int = SEED):
    """Text, first word (within the text), number of windows and minimiser of each."""
    n = len(t.start)
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    words = t.byte_hashes().of(t.start, t.end)
    at = np.arange(n - seed + 1)
    low = SpanHashes(words, _SEED_BASE).of(at, at + seed)
    low[t.doc[at] != t.doc[at + seed - 1]] = _NONE
    span, done = window - seed + 1, 1
    while 2 * done <= span:                              # minima of 1, 2, 4 ... neighbours
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if span > done:
        low = np.minimum(low[:len(low) - (span - done)], low[span - done:])
    first = np.arange(n - window + 1)
    good = t.doc[first] == t.doc[first + window - 1]
    new = good.copy()
    new[1:] &= ~(good[:-1] & (low[1:] == low[:-1]) & (t.doc[1:len(low)] == t.doc[:len(low) - 1]))
    run = np.maximum.accumulate(np.where(new, first, 0))
    new |= good & ((first - run) % LONGEST == 0)
    start = np.flatnonzero(new)
    count = np.add.reduceat(good.astype(np.int64), start) if len(start) else start
    doc = t.doc[start]
    word_zero = np.cumsum(t.counts) - t.counts
    return doc, start - word_zero[doc], count, low[start].astype(np.int64)


def _key_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a 128-bit key of both, never null."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"),
                       F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"))


def descriptors(docs: DataFrame, window: int) -> DataFrame:
    """Super-k-mers of keyed documents, without their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, first, count, key = super_kmers(Texts(part.column("text")), window)
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(doc) for c in ("doc_id", "k1", "k2")),
                     pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(key, pa.int64())],
                    names=["doc_id", "k1", "k2", "first", "n", "key"])

    return (docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
            .mapInArrow(run, f"doc_id {_key_type(docs)}, k1 bigint, k2 bigint, first int, n int, key bigint"))


def packed(docs: DataFrame, window: int, single: bool) -> DataFrame:
    """The strings that travel, cut from documents with a list of super-k-mers; `single`: the
    digests of their windows instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                t = Texts(part.column("text"))
                zero = (np.cumsum(t.counts) - t.counts).tolist()
                whole = t.buf.tobytes()
                start, end = t.start.tolist(), t.end.tolist()
                rows = []
                for d, shared in enumerate(part.column("shared").to_pylist()):
                    for s in shared:
                        a, n = zero[d] + s["first"], s["n"]
                        if not single:
                            rows.append((d, s["first"], s["key"],
                                         b" ".join(whole[start[a]:end[a + n + window - 2]].split())))
                            continue
                        for k in range(n):
                            words = b" ".join(whole[start[a + k]:end[a + k + window - 1]].split())
                            rows.append((d, s["first"] + k, s["key"], hashlib.blake2b(words, digest_size=16).digest()))
                doc, first, key, text = zip(*rows) if rows else ((),) * 4
                doc = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(doc) for c in ("doc_id", "k1", "k2")), pa.array(first, pa.int32()),
                     pa.array(key, pa.int64()), pa.array(text, pa.binary())],
                    names=["doc_id", "k1", "k2", "first", "key", "packed"])

    return docs.mapInArrow(run, f"doc_id {_key_type(docs)}, k1 bigint, k2 bigint, first int, key bigint, packed binary")


def smallest_of_windows(strings: dict[bytes, int], window: int) -> dict[bytes, list[int]]:
    """For each string (with its smallest document), the smallest document of each window."""
    entries = []
    for text, doc in strings.items():
        starts = [0]
        at = text.find(b" ")
        while at >= 0:
            starts.append(at + 1)
            at = text.find(b" ", at + 1)
        ends = [s - 1 for s in starts[1:]] + [len(text)]
        entries += [(text[starts[k]:ends[k + window - 1]], doc, k, text) for k in range(len(starts) - window + 1)]
    entries.sort()
    out: dict[bytes, dict[int, int]] = {text: {} for text in strings}
    last, least = None, 0
    for words, doc, k, text in entries:
        if words != last:
            last, least = words, doc                     # the sort puts the smallest document first
        out[text][k] = least
    return {text: [own[k] for k in range(len(own))] for text, own in out.items()}


MARKS = "k1 bigint, k2 bigint, places array<int>"


def _bucketed(strings: DataFrame, window: int) -> DataFrame:
    """Sorts each bucket's windows; a bucket's rows lie next to each other in a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket = None, []

        def close() -> list[tuple]:
            smallest: dict[bytes, int] = {}
            for doc, _, _, _, text in bucket:
                smallest[text] = min(doc, smallest.get(text, doc))
            if len(set(smallest.values())) == 1 and all(b[0] == bucket[0][0] for b in bucket):
                return []                                # one document alone
            least = smallest_of_windows(smallest, window)
            found = []
            for doc, k1, k2, first, text in bucket:
                places = [first + k for k, d in enumerate(least[text]) if d < doc]
                if places:
                    found.append((k1, k2, places))
            return found

        def as_batch(found: list[tuple]) -> pa.RecordBatch:
            k1, k2, places = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(places, pa.list_(pa.int32()))],
                names=["k1", "k2", "places"])

        for batch in batches:
            found = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "k1", "k2", "first", "packed"))):
                if k != key and bucket:
                    found += close()
                    bucket = []
                key = k
                bucket.append(row)
            yield as_batch(found)
        if bucket:
            yield as_batch(close())

    return strings.repartition("key").sortWithinPartitions("key").mapInArrow(run, MARKS)


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, marked) for documents with repeated windows: the first words of the windows that
    also start in a smaller document, in lists."""
    texts = keyed(docs)
    found = materialize(descriptors(texts, window), "super_kmers")
    shared = materialize(
        found.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("met"))
        .filter("low < high").select("key", (F.col("met") > HOT).alias("hot")), "minimisers")

    def cut(hot: bool) -> DataFrame:
        lists = (found.join(shared.filter(F.col("hot") == hot), "key").groupBy("k1", "k2")
                 .agg(F.collect_set(F.struct("first", "n", "key")).alias("shared")))
        return packed(texts.join(lists, ["k1", "k2"]), window, hot)

    marks = _bucketed(cut(False), window)
    if not shared.filter("hot").isEmpty():
        # equal digests are combined before the shuffle; the join splits hot ones by size
        least = cut(True).groupBy("packed").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        single = (cut(True).join(least.filter("least < most"), "packed").filter("least < doc_id")
                  .select("k1", "k2", F.array("first").alias("places")))
        marks = marks.union(single)
    return marks.groupBy("k1", "k2").agg(F.collect_set("places").alias("marked"))


def _with_marks(docs: DataFrame, window: int) -> DataFrame:
    """The rows of `docs` with `__marked`; rows without repeated words have null there."""
    marks = repeated_words(docs.select("doc_id", "text"), window).select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("marked").alias("__marked"))
    rows = docs.withColumns({"__h1": F.xxhash64("doc_id", "text"), "__h2": F.xxhash64(F.lit(7), "text", "doc_id")})
    return rows.join(marks, (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")), "left")


def kept_words(t: Texts, marked: list, window: int) -> np.ndarray:
    """Which words stay, given each text's lists of windows (or None)."""
    change = np.zeros(len(t.start) + 1, np.int64)
    zero = np.cumsum(t.counts) - t.counts
    for d, lists in enumerate(marked):
        if lists:
            at = np.concatenate([np.asarray(x, np.int64) for x in lists]) + zero[d]
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
    return np.cumsum(change)[:-1] == 0


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                t = Texts(part.column("text"))
                keep = kept_words(t, part.column("__marked").to_pylist(), window)
                whole, off = t.buf.tobytes(), np.concatenate([[0], np.cumsum(t.counts)])
                removed = np.bincount(t.doc[~keep], minlength=t.n)[:t.n]
                found = []
                for d in range(t.n):
                    if removed[d]:
                        own = off[d] + np.flatnonzero(keep[off[d]:off[d + 1]])
                        text = b" ".join([whole[a:b] for a, b in zip(t.start[own].tolist(), t.end[own].tolist())])
                    else:
                        text = b" ".join(whole[t.off[d]:t.off[d + 1]].split())
                    found.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(t.counts, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(found, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_marks(docs.select("doc_id", "text"), window).select("doc_id", "text", "__marked").mapInArrow(
        run, f"doc_id {_key_type(docs)}, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without repeated passages: the words go with the white space after them. Rows of
    which nothing is left go; `n_chars`, where there is such a column, follows the text."""
    plain, back = aside(docs, ["doc_id", "text", "n_chars"])
    columns = plain.columns
    touched = _with_marks(plain, window).select(*columns, "__marked")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "__empty boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                marked = part.column("__marked").to_pylist()
                texts = part.column("text").to_pylist()
                t = Texts(part.column("text"))
                keep = kept_words(t, marked, window)
                off = np.concatenate([[0], np.cumsum(t.counts)])
                whole, empty = t.buf.tobytes(), [False] * t.n
                for d in [d for d, m in enumerate(marked) if m]:
                    a, b = off[d], off[d + 1]
                    own = keep[a:b]
                    edges = np.append(t.start[a + 1:b], t.off[d + 1])   # a word's white space goes with it
                    text = b"".join(whole[s:e] for s, e in zip(t.start[a:b][own].tolist(), edges[own].tolist()))
                    texts[d], empty[d] = text.decode().rstrip(), not own.any()
                arrays = []
                for name in columns:
                    values = part.column(name)
                    if name == "text":
                        values = pa.array(texts, pa.string())
                    elif name == "n_chars" and pa.types.is_integer(values.type):
                        values = pa.array([len(x) if m else n for x, m, n in
                                           zip(texts, marked, values.to_pylist())], values.type)
                    arrays.append(values)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(empty)], names=[*columns, "__empty"])

    return back(touched.mapInArrow(run, schema).filter("NOT __empty"))
