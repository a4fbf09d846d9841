"""Near-duplicate classes by improved consistent weighted sampling.

1. Shingles are runs of five words, weighted by term frequency (sublinear, 1 + ln count, so
   that one phrase said a hundred times does not make texts alike) times an inverse document
   frequency. Frequencies are counted over the whole corpus in a hashed space of `FEATURES`
   counters (fixed size, summed in streams). The factor is damped to 1..1.1: undamped, the
   shingles that thousands of near copies share would hardly count beside their differences.
2. Each text draws `BANDS * ROWS` consistent weighted samples; a band hashes `ROWS` of them.
   At similarity 0.8 a pair shares a band with probability 0.9994.
3. Buckets of at most `SMALL` texts compare all their pairs. A larger one compares its members
   with one pivot, the best connected member, which joins a group of copies in linear time.
   What that leaves open is settled by distances (1 - similarity is a metric): members near
   the pivot cannot be alike to one that is further than twice the bound. All other pairs of
   different classes are compared, whatever the size of the bucket: its members are dealt to
   blocks of at most about `BLOCK` texts and `BLOCK_BYTES`, and every two blocks meet in a group
   of their own, as matrices; members of the largest class do not meet each other. So no pair
   that shares a bucket is lost. A bucket of m members outside its largest class and n in it
   costs m * (m + n) comparisons and m * (m + n) / `BLOCK` rows.
4. Weighted Jaccard similarity, sum of minima over sum of maxima, decides; linked texts are
   joined to classes by connected components. Hot pivots are split by salts.

Equal texts are one node throughout. Defined results. Null text or text without a word: no
similarity, a class of its own per row. Texts of one to four words are one shingle. The
class id is the smallest doc_id of the class (null ids do not count; null if there is no
other). Repeated rows share their class. Empty table: no rows. Other columns pass through
`one_of_each` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataward.llm.components import components
from dataward.llm.words import SpanHashes, Texts, aside, mix, slices
from dataward.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
FEATURES = 1 << 16
CHUNK = 4096
DAMPING = 0.1
SMALL = 8                   # texts of a bucket whose pairs are all compared
CLOSE = 1e-9                # similarities so close to a bound are computed once more, or count as within it
BLOCK, BLOCK_BYTES = 2048, 8 << 20   # texts and bytes of packed shingles in one of the blocks that are compared
FREQUENT = 100              # shingles in more than one of so many pairs of two blocks are multiplied as matrices
PAIRS, COLUMNS = 1 << 21, 1024        # pairs and shingles taken at once there
SLICE = 4 << 20             # bytes of packed shingles unpacked at once
PER_SALT = 512              # comparisons with one pivot in one group
_BASE = 0xD1342543DE82EF95
_rng = np.random.default_rng(97)
_R = _rng.gamma(2.0, 1.0, 1 << 16)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16))
_BETA = _rng.random(1 << 16)
_SPREAD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of the distinct shingles, ordered by text and hash."""
    words = t.byte_hashes().of(t.start, t.end)
    n = len(words)
    hashes = SpanHashes(words, _BASE)
    at = np.arange(max(n - SHINGLE + 1, 0))
    at = at[t.doc[at] == t.doc[at + SHINGLE - 1]]
    short = np.flatnonzero((t.counts > 0) & (t.counts < SHINGLE))
    zero = (np.cumsum(t.counts) - t.counts)[short]
    start = np.concatenate([at, zero])
    end = np.concatenate([at + SHINGLE, zero + t.counts[short]])
    doc, value = t.doc[start], hashes.of(start, end) >> np.uint64(32)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return doc[first], value[first].astype(np.uint32), np.diff(np.append(first, len(doc)))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Number of rows with a shingle in each hashed feature; the last entry counts rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                doc, value, _ = shingles(Texts(part.column("text")))
                pairs = np.unique(doc * FEATURES + (value % FEATURES))
                total += np.bincount(pairs % FEATURES, minlength=FEATURES)
                rows += part.num_rows
        chunks = [total[k:k + CHUNK] for k in range(0, FEATURES, CHUNK)] + [np.array([rows])]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(chunks)), pa.int32()), pa.array([c.tobytes() for c in chunks])],
                names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(counts, np.int64)
                sums[chunk] = sums[chunk] + values if chunk in sums else values
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([v.tobytes() for v in sums.values()])],
                                             names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    found = docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect()
    parts = {r["chunk"]: np.frombuffer(r["counts"], np.int64) for r in found}   # FEATURES numbers
    return np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros(FEATURES + 1, np.int64)


def factors(frequencies: np.ndarray) -> np.ndarray:
    """The damped inverse document frequency of each hashed feature."""
    rows = frequencies[-1]
    if not rows:
        return np.ones(FEATURES)
    return 1 + DAMPING * np.log((rows + 1) / (frequencies[:-1] + 1)) / np.log(rows + 1)


def weights(value: np.ndarray, count: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """TF-IDF weight of shingles with their counts in one text."""
    return (1 + np.log(count)) * factor[value % FEATURES]


def samples(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int,
            spreads: np.ndarray = _SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """Consistent weighted samples: for each text with shingles, one 64-bit key per draw."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros((0, len(spreads)), np.uint64)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    sizes = np.diff(np.append(first, len(doc)))
    key, log_w = mix(value.astype(np.uint64)), np.log(weight)
    out = np.empty((len(first), len(spreads)), np.uint64)
    for k, spread in enumerate(spreads):
        at = (key * spread) >> np.uint64(48)
        r, beta = _R[at], _BETA[at]
        t = np.floor(log_w / r + beta)
        log_a = _LOG_C[at] - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, first)
        hit = np.flatnonzero(log_a == np.repeat(least, sizes))
        hit = hit[np.append(True, doc[hit][1:] != doc[hit][:-1])]
        out[:, k] = mix(key[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(_BASE) + np.uint64(k))
    return doc[first], out


def bands(keys: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One bucket key per text and band."""
    out = np.empty((len(keys), count), np.uint64)
    for b in range(count):
        value = np.full(len(keys), b + 1, np.uint64)
        for k in range(rows):
            value = mix(value * np.uint64(_BASE) + keys[:, b * rows + k])
        out[:, b] = value
    return out.astype(np.int64)


def _node() -> Column:
    """The digest that stands for a text: 16 bytes."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _typed(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def signatures(docs: DataFrame, factor: np.ndarray) -> DataFrame:
    """doc_id, node (digest of the text) and band keys of each row; null keys without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, value, count = shingles(Texts(part.column("text")))
                which, keys = samples(doc, value, weights(value, count, factor), part.num_rows)
                found: list = [None] * part.num_rows
                for d, own in zip(which.tolist(), bands(keys).tolist()):
                    found[d] = own
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("node"), pa.array(found, pa.list_(pa.int64()))],
                    names=["doc_id", "node", "bands"])

    return (docs.select("doc_id", _node().alias("node"), "text")
            .mapInArrow(run, f"doc_id {_typed(docs)}, node binary, bands array<bigint>"))


def vectors(texts: DataFrame) -> DataFrame:
    """Shingles (sorted) and counts of each node's text, as packed arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, value, count = shingles(Texts(part.column("text")))
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
                count = count.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"),
                     pa.array([value[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                     pa.array([count[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())],
                    names=["node", "shingles", "counts"])

    return texts.select("node", "text").mapInArrow(run, "node binary, shingles binary, counts binary")


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights, total weight)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    least = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(least / (a[2] + b[2] - least)) if least else 0.0


def _unpacked(shingle: bytes, count: bytes, factor: np.ndarray) -> tuple:
    value = np.frombuffer(shingle, np.uint32)
    weight = weights(value, np.frombuffer(count, np.uint32), factor)
    return value, weight, weight.sum()


def verified(pairs: DataFrame, vector: DataFrame, factor: np.ndarray, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs (pivot, node) that are similar enough. Rows come grouped
    by pivot and salt, the pivot's own vector first, and are compared as they stream by."""
    spread = (pairs.groupBy("pivot").agg(F.count("*").alias("n"))
              .select("pivot", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts")))
    mine = (spread.join(vector, F.col("pivot") == F.col("node"))
            .select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                    F.lit(None).cast("binary").alias("node"), "shingles", "counts"))
    others = (pairs.join(spread, "pivot").join(vector, "node")
              .select("pivot", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"),
                      "node", "shingles", "counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for batch in batches:
            found = []
            for part in slices(batch, "shingles", SLICE):
                for pivot, node, shingle, count in zip(*(part.column(c).to_pylist()
                                                         for c in ("pivot", "node", "shingles", "counts"))):
                    own = _unpacked(shingle, count, factor)
                    if node is None:
                        centre = own
                    elif (alike := similarity(centre, own)) >= least:
                        found.append((pivot, node, alike))
            a, b, alike = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()),
                                              pa.array(alike, pa.float64())], names=["a", "b", "similarity"])

    return (mine.union(others).repartition("pivot", "salt")
            .sortWithinPartitions("pivot", "salt", F.asc_nulls_first("node"))
            .mapInArrow(run, "a binary, b binary, similarity double"))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, node (digest of the text), class_node and class_id of each row; class_node, the
    smallest node of the class, is null for rows without words."""
    factor = factors(document_frequencies(docs))
    signed = materialize(signatures(docs, factor), "signatures")
    nodes = (signed.filter("bands IS NOT NULL").groupBy("node")
             .agg(F.min("doc_id").alias("low"), F.any_value("bands").alias("bands")))
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    met = rows.join(sizes, "bucket")
    degree = met.groupBy("node").agg(F.sum("size").alias("degree"))
    known = materialize(met.select("bucket", "node").join(degree, "node"), "buckets")
    needed = nodes.select(F.col("node").alias("own"), "low").join(degree, F.col("own") == degree["node"], "left_semi")
    texts = (docs.select(_node().alias("node"), "text", "doc_id")
             .join(needed, (F.col("node") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("low"))))
    vector = materialize(vectors(texts).dropDuplicates(["node"]), "vectors")
    rooted = _linked(known, vector, factor, least)
    low = (nodes.select("node", "low").join(rooted, "node")
           .groupBy("root").agg(F.min("low").alias("class_low")))
    named = rooted.join(low, "root")
    class_of = (nodes.select("node", "low").join(named, "node", "left")
                .select("node", F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("class_low"))
                        .alias("class_id"), F.coalesce("root", "node").alias("class_node")))
    return (signed.select("doc_id", "node").join(class_of, "node", "left")
            .select("doc_id", "node", "class_node", F.when(F.col("class_node").isNull(), F.col("doc_id"))
                    .otherwise(F.col("class_id")).alias("class_id")))


def _linked(known: DataFrame, vector: DataFrame, factor: np.ndarray, least: float) -> DataFrame:
    """(node, root) of the linked nodes of buckets (bucket, node, degree): pairs of small buckets
    and pivots of large ones first, then all pairs that these leave open."""
    rooted = known.sparkSession.createDataFrame([], "node binary, root binary")
    members = materialize(_open(known, rooted), "members")
    pairs = materialize(_small_pairs(members).union(_star_pairs(members)).distinct(), "pairs")
    near = materialize(verified(pairs, vector, factor, 2 * least - 1 - CLOSE), "near")
    rooted = _joined(near.filter(F.col("similarity") >= least), rooted)
    left = materialize(_left(members, near, rooted, least), "left")
    if left.isEmpty():
        return rooted
    return _joined(materialize(_block_links(left, vector, factor, least), "block-links"), rooted)


def _joined(links: DataFrame, rooted: DataFrame) -> DataFrame:
    """(node, root) after further links: only those between different classes are followed."""
    def root_of(name: str) -> DataFrame:
        return rooted.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))

    ends = (links.select("a", "b").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
            .select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
            .filter("a <> b").distinct())
    ends = materialize(ends, "links")
    if ends.isEmpty():
        return rooted
    moved = materialize(components(ends), "classes").select(F.col("node").alias("old"), F.col("root").alias("new"))
    kept = rooted.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = moved.join(rooted, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return materialize(kept.union(fresh), "classes")


def _rooted(rows: DataFrame, rooted: DataFrame) -> DataFrame:
    return rows.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(known: DataFrame, rooted: DataFrame) -> DataFrame:
    """Members (bucket, node, degree, root) of the buckets that hold more than one class, with
    the size and the best connected member of each."""
    mine = _rooted(known, rooted)
    facts = (mine.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.min(F.struct((-F.col("degree")).alias("degree"), "node")).alias("best"))
        .filter("low <> high").select("bucket", "size", F.col("best.node").alias("pivot")))
    return mine.join(facts, "bucket")


def _small_pairs(members: DataFrame) -> DataFrame:
    """All pairs of different classes in small buckets: at most SMALL members are listed."""
    listed = (members.filter(F.col("size") <= SMALL).groupBy("bucket")
              .agg(F.sort_array(F.collect_list(F.struct("node", "root"))).alias("all")))
    pairs = F.flatten(F.transform("all", lambda a: F.transform(
        F.filter("all", lambda b: (a["node"] < b["node"]) & (a["root"] != b["root"])),
        lambda b: F.struct(a["node"].alias("pivot"), b["node"].alias("node")))))
    return listed.select(F.inline(pairs))


def _star_pairs(members: DataFrame) -> DataFrame:
    """The pivots of large buckets and the other members."""
    return members.filter((F.col("size") > SMALL) & (F.col("node") != F.col("pivot"))).select("pivot", "node")


def _left(members: DataFrame, near: DataFrame, rooted: DataFrame, least: float) -> DataFrame:
    """(bucket, node, degree, root) of the members of large buckets that may still have a link to
    another class there. `near` has the similarities to the pivot from 2 * least - 1 on; who is
    missing there is further from it than any member linked to it can reach."""
    own = members.filter(F.col("size") > SMALL).select("bucket", "node", "degree", "pivot")
    seen = (_rooted(own, rooted)
            .join(near.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "similarity"), ["pivot", "node"], "left")
            .withColumn("similarity", F.when(F.col("node") == F.col("pivot"), 1.0).otherwise(F.col("similarity"))))
    main = seen.groupBy("bucket").agg(F.max(F.when(F.col("node") == F.col("pivot"), F.col("root"))).alias("main"))
    known = seen.join(main, "bucket")
    facts = (known.filter("root <> main").groupBy("bucket")
             .agg(F.max(F.when(F.col("similarity") < least, F.col("similarity"))).alias("closest")))
    # a near member x is in reach of an outsider y if d(pivot, x) >= d(pivot, y) - (1 - least)
    reach = F.col("similarity") <= 1 - least + F.col("closest") + 1e-9
    kept = (known.join(facts, "bucket")
            .filter(F.col("similarity").isNull() | (F.col("similarity") < least) | F.coalesce(reach, F.lit(False))))
    open_still = kept.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return kept.join(open_still.select("bucket"), "bucket", "left_semi").select("bucket", "node", "degree", "root")


def _blocks(left: DataFrame, vector: DataFrame) -> DataFrame:
    """(bucket, first, second, number, node, root, shingles, counts): the members of each bucket in
    blocks of bounded size, one group (bucket, first, second) for every two blocks whose members
    have to meet. Members of a bucket's largest class are in blocks of their own, which meet
    those of the others only."""
    sizes = left.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("largest")).select(
        "bucket", F.col("largest.root").alias("main"))
    told = left.join(main, "bucket").select("bucket", "node", "root", (F.col("root") != F.col("main")).alias("beside"))
    lengths = vector.select("node", (F.length("shingles") + F.length("counts")).alias("bytes"))

    def number(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")

    facts = (told.join(lengths, "node").groupBy("bucket").agg(
        number(F.count("*"), F.sum("bytes")).alias("all"),
        number(F.count_if("beside"), F.sum(F.when(F.col("beside"), F.col("bytes")))).alias("own"),
        number(F.count_if(~F.col("beside")), F.sum(F.when(~F.col("beside"), F.col("bytes")))).alias("others"))
        # what fits one block is one
        .select("bucket", F.when(F.col("all") == 1, 1).otherwise(F.col("own")).alias("own"),
                F.when(F.col("all") == 1, 0).otherwise(F.col("others")).alias("others")))
    place = F.xxhash64("node")
    dealt = told.join(facts, "bucket").withColumn(
        "number", F.when(F.col("beside") | (F.col("others") == 0), F.pmod(place, F.col("own")))
        .otherwise(F.col("own") + F.pmod(place, F.col("others"))).cast("int"))
    met = F.when(F.col("number") < F.col("own"), F.sequence(F.lit(0), F.col("own") + F.col("others") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("own") - 1))
    return (dealt.select("bucket", "node", "root", "number", F.explode(met).alias("other")).join(vector, "node")
            .select("bucket", F.least("number", "other").alias("first"), F.greatest("number", "other").alias("second"),
                    "number", "node", "root", "shingles", "counts"))


def _block_links(left: DataFrame, vector: DataFrame, factor: np.ndarray, least: float) -> DataFrame:
    """(a, b): links that join what all links between the members of a bucket join. Two blocks
    are compared as matrices; a group returns fewer links than it has members."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        number = rows.column("number").to_numpy()
        node, root = rows.column("node").to_pylist(), rows.column("root").to_pylist()
        texts = [(np.frombuffer(v, np.uint32), np.frombuffer(c, np.uint32))
                 for v, c in zip(rows.column("shingles").to_pylist(), rows.column("counts").to_pylist())]
        x = np.flatnonzero(number == first)
        y = np.flatnonzero(number == second)
        total = np.array([weights(v, c, factor).sum() for v, c in texts])
        least_sum = _least_sums([texts[i] for i in x], [texts[i] for i in y], factor)
        alike = least_sum / (total[x][:, None] + total[y][None, :] - least_sum)
        linked = alike >= least - CLOSE
        for i, j in np.argwhere(linked & (alike < least + CLOSE)).tolist():     # rounding must not decide
            a, b = ((texts[k][0], weights(*texts[k], factor), total[k]) for k in (x[i], y[j]))
            linked[i, j] = similarity(a, b) >= least
        ids = {r: k for k, r in enumerate(dict.fromkeys(root))}
        edges = [(node[x[i]], node[y[j]]) for i, j in _forest(linked, np.array([ids[root[k]] for k in x], np.int64),
                                                              np.array([ids[root[k]] for k in y], np.int64))]
        a, b = zip(*edges) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return (_blocks(left, vector).groupBy("bucket", "first", "second")
            .applyInArrow(run, "a binary, b binary").distinct())


def _least_sums(x: list, y: list, factor: np.ndarray) -> np.ndarray:
    """Sum of minima of the weights for every text of x and of y, each (shingles, counts). A shingle
    that is met n times has one layer for each count up to n; minima are the layers both have."""
    out = np.zeros((len(x), len(y)))
    counts = [np.concatenate([c for _, c in own]) for own in (x, y)]
    levels = np.unique(np.concatenate(counts))
    if not len(levels):
        return out
    gain = np.diff(1 + np.log(levels), prepend=0.0)
    text, code = [], []
    for own, count in zip((x, y), counts):
        doc = np.repeat(np.arange(len(own)), [len(v) for v, _ in own])
        value = np.concatenate([v for v, _ in own]).astype(np.int64)
        layers = np.searchsorted(levels, count, side="right")
        place = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
        text.append(np.repeat(doc, layers))
        code.append(np.repeat(value, layers) * len(levels) + place)
    both = np.intersect1d(code[0], code[1])
    weight = gain[both % len(levels)] * factor[(both // len(levels)) % FEATURES]
    starts, sizes = [], []
    for k in (0, 1):                                   # by layer, those that both sides have
        at = np.searchsorted(both, code[k])
        at[at == len(both)] = 0
        kept = np.flatnonzero(both[at] == code[k]) if len(both) else np.zeros(0, np.int64)
        order = kept[np.argsort(at[kept], kind="stable")]
        text[k], code[k] = text[k][order], at[order]
        sizes.append(np.bincount(code[k], minlength=len(both)))
        starts.append(np.cumsum(sizes[k]) - sizes[k])
    pairs = sizes[0] * sizes[1]
    frequent = pairs * FREQUENT > out.size
    rare = np.flatnonzero(~frequent)
    upto = np.cumsum(pairs[rare])
    for part in np.split(rare, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS))) if len(rare) else ():
        n = pairs[part]
        own = np.repeat(part, n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = text[0][starts[0][own] + place // sizes[1][own]]
        j = text[1][starts[1][own] + place % sizes[1][own]]
        out += np.bincount(i * len(y) + j, weight[own], out.size).reshape(out.shape)
    dense = np.flatnonzero(frequent)
    for part in (dense[k:k + COLUMNS] for k in range(0, len(dense), COLUMNS)):
        sides = []
        for k in (0, 1):
            own = np.repeat(np.arange(len(part)), sizes[k][part])
            place = np.arange(len(own)) - np.repeat(np.cumsum(sizes[k][part]) - sizes[k][part], sizes[k][part])
            side = np.zeros(((len(x), len(y))[k], len(part)))
            side[text[k][starts[k][part][own] + place], own] = 1.0
            sides.append(side)
        out += (sides[0] * weight[part]) @ sides[1].T
    return out


def _forest(linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places (row, column) of links that join all classes that `linked` joins, none of them twice;
    x and y are the classes of rows and columns. Every turn each class takes a link to another."""
    label = np.arange(max(x.max(), y.max()) + 1)
    out: list[tuple[int, int]] = []

    def top(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    while True:
        now = np.array([top(k) for k in range(len(label))])
        open_still = linked & (now[x][:, None] != now[y][None, :])
        rows = np.flatnonzero(open_still.any(axis=1))
        if not len(rows):
            return out
        for i, j in zip(rows.tolist(), open_still[rows].argmax(axis=1).tolist()):
            a, b = top(x[i]), top(y[j])
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((i, j))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each class: the one of its smallest doc_id; of rows with the same
    doc_id and text, the one whose other columns come first as JSON. Rows without words stay."""
    plain, back = aside(docs, ["doc_id", "text"])
    found = classes(plain.select("doc_id", "text"), least)
    keys = (found.filter("class_node IS NOT NULL").groupBy("class_node")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("best"))
            .select(F.col("best.doc_id").alias("__doc"), F.col("best.node").alias("__node"), F.lit(True).alias("__once")))
    loose = (found.filter("class_node IS NULL").select(F.col("doc_id").alias("__doc"), F.col("node").alias("__node"))
             .distinct().withColumn("__once", F.lit(False)))
    joined = plain.withColumn("__own", _node()).join(
        keys.union(loose), F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("__own").eqNullSafe(F.col("__node")))
    others = F.to_json(F.struct(F.lit(0), *[c for c in plain.columns if c not in ("doc_id", "text")]))
    same = Window.partitionBy("__doc", "__node").orderBy(others)
    return back(joined.withColumn("__copy", F.row_number().over(same)).filter(~F.col("__once") | (F.col("__copy") == 1)))
