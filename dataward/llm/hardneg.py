"""Hard-negative mining with angular triangle filtering.

1. At most `REFERENCES` rows of each vector length give reference directions. Every vector
   stores its angles to them and its norm. Rows are dealt by range of (nearest reference,
   label, angle), so the tiles of `TILE` rows of a block are alike.
2. The angle between an anchor and a row lies between the largest difference and the smallest
   sum of their angles to a reference. Its cosine, times the norms, widened by more than the
   rounding, bounds the score. A tile is left out if its bounds, taken over all references,
   meet no window of the anchor; so is a row by its nearest reference.
3. What is left gets its integer score. Positives: the window is everything above the k-th
   score so far. Negatives: the windows that the positives' scores give, cut likewise. The
   best of each pair of blocks are merged by rank.

Anchors meet the rows in groups of blocks, each with a copy of all anchors. Blocks are joined
by sorting: Spark's guess of a side's size leaves out the copies, and would broadcast them.
Rows are dealt to at most `RANGES` ranges, since Spark gathers some 300 keys of each on the
driver; a range may hold many blocks.

References only decide how much is left out, never the result; lengths of vectors beyond the
`LENGTHS` most common ones have none, and all their rows are scored.

Defined results. Rows with a null id, label or vector, or a null or non-finite component take
no part. Vectors of different lengths never meet. A row's own vector is left out by row, so
another row with the same id counts; ties beyond the id are between equal rows. Anchors
without a positive give nothing. Empty table: no rows. Other columns are ignored. Scores
must fit in a long.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dataward.session import materialize

REFERENCES = 16             # per length of vectors
LENGTHS = 64                # lengths of vectors that have references
BLOCK = 4096                # rows in a block
ANCHORS = 512               # anchors in a block
TILE = 32                   # rows of a block that are left out together
RANGES = 512                # ranges that rows are dealt to
GROUPS = 128                # groups of blocks, each with a copy of the anchors; more if one held over HELD blocks
HELD = 64                   # blocks of a group, on average; a task holds a group's blocks
CARRIED = 64                # blocks of anchors whose lowest useful scores a task remembers
SLACK = 2e-6                # radians by which angles are widened; arccos is off by 1e-7 at most
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
ROWS = ("dim int, vec_id bigint, label bigint, ref int, angle double, norm double, angles array<double>, "
        "vector array<bigint>")
BLOCKS = ("block bigint, dim int, ids array<bigint>, labels array<bigint>, refs array<int>, norms array<double>, "
          "own_blocks array<bigint>, own_places array<int>, angles binary, data binary")
HITS = ("a_block bigint, a_place int, anchor_id bigint, slot int, positive_id bigint, positive_score bigint, "
        "vec_id bigint, score bigint, block bigint, place int")


def labelled(vectors: DataFrame, scale: int = 256, every: int = 7, labels: int = 10) -> DataFrame:
    """dim, vec_id, label and floor(scale * x) of the rows that take part; the labels of ids
    divisible by `every` are moved on by one."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label").cast("bigint")
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                           & F.col("embedding").isNotNull() & finite)
            .select(F.size("embedding").alias("dim"), F.col("vec_id").cast("bigint").alias("vec_id"),
                    F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label).alias("label"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("vector")))


def references(rows: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors by length: at most LENGTHS * REFERENCES rows reach the driver."""
    common = [r["dim"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()]
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id")
    picked = (rows.filter(F.col("dim").isin(common) & F.exists("vector", lambda x: x != 0))
              .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= REFERENCES))
    found: dict[int, list] = {}
    for r in picked.select("dim", "place", "vector").collect():
        v = np.array(r["vector"], float)
        found.setdefault(r["dim"], []).append((r["place"], v / np.linalg.norm(v)))
    return {dim: np.array([v for _, v in sorted(own, key=lambda x: x[0])]) for dim, own in found.items()}


def angles(data: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of integer vectors and their angles to unit vectors (a zero vector: a right angle)."""
    data = data.astype(np.float64)
    norm = np.sqrt((data * data).sum(axis=1))
    cosine = (data @ directions.T) / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(cosine, -1, 1))


def _stored(rows: DataFrame, directions: dict[int, np.ndarray]) -> DataFrame:
    """The rows with their norm, their angles and the nearest reference."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = pa.array(np.flatnonzero(dims == dim))
                part = batch.take(own)
                lists = part.column("vector")
                data = lists.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                norm, angle = angles(data, directions.get(dim, np.zeros((0, dim))))
                width = angle.shape[1]
                near = angle.argmin(axis=1) if width else np.zeros(part.num_rows, np.int64)
                least = angle.min(axis=1) if width else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), part.column("vec_id"), part.column("label"), pa.array(near, pa.int32()),
                     pa.array(least), pa.array(norm),
                     pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * width, pa.int32()),
                                              pa.array(angle.ravel())), lists],
                    names=[c.split()[0] for c in ROWS.split(", ")])

    return rows.mapInArrow(run, ROWS)


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Sorted rows packed into blocks of one vector length. Rows with own_block keep that place
    as theirs, others get the one they have here."""
    kept = "own_block" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, waiting, size = TaskContext.get().partitionId() << 32, [], 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            n, dim = rows.num_rows, rows.column("dim")[0].as_py()

            def flat(name: str) -> np.ndarray:
                return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

            data = flat("vector")
            top = int(np.abs(data).max(initial=0))
            data = data.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)
            places = rows.column("own_place").to_pylist() if kept else list(range(n))
            owners = rows.column("own_block").to_pylist() if kept else [serial] * n
            return pa.RecordBatch.from_arrays(
                [pa.array([serial]), pa.array([dim], pa.int32()),
                 *(pa.array([rows.column(c).to_pylist()], pa.list_(k)) for c, k in
                   (("vec_id", pa.int64()), ("label", pa.int64()), ("ref", pa.int32()), ("norm", pa.float64()))),
                 pa.array([owners], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.int32())),
                 pa.array([flat("angles").astype(np.float64).tobytes()], pa.binary()),
                 pa.array([data.tobytes()], pa.binary())],
                names=[c.split()[0] for c in BLOCKS.split(", ")])

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, size
            table = pa.Table.from_batches(waiting)
            dims = table.column("dim").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, dims[1:] != dims[:-1])), len(dims))
            rest = len(dims)
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                whole = last or b < len(dims)              # the last run may go on in the next batch
                stop = b if whole else a + (b - a) // most * most
                for at in range(a, stop, most):
                    yield block(table.slice(at, min(most, stop - at)))
                rest = stop
            waiting = table.slice(rest).to_batches()
            size = len(dims) - rest

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
                if size >= most:
                    yield from ready(False)
        if size:
            yield from ready(True)

    return rows.mapInArrow(run, BLOCKS)


class Block:
    """One row of BLOCKS as arrays."""

    def __init__(self, row: dict, prefix: str):
        def values(name: str) -> np.ndarray:
            return row[f"{prefix}{name}"].values.to_numpy(zero_copy_only=False)

        self.number, self.dim = row[f"{prefix}block"].as_py(), row["dim"].as_py()
        self.ids, self.labels, self.refs, self.norms = (values(c) for c in ("ids", "labels", "refs", "norms"))
        self.owners, self.places = values("own_blocks"), values("own_places").astype(np.int64)
        n = len(self.ids)
        self.angles = np.frombuffer(row[f"{prefix}angles"].as_py(), np.float64).reshape(n, -1)
        data = row[f"{prefix}data"].as_py()
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (n * self.dim)] if self.dim else np.int64
        self.data = np.frombuffer(data, kind).astype(np.int64).reshape(n, self.dim)


def _scores(anchors: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; by floating point where no sum can lose a unit."""
    if exact:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


def score_bounds(angle_low: np.ndarray, angle_high: np.ndarray, anchor_norm: np.ndarray, norm_low: np.ndarray,
                 norm_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most possible score for angles and norms in given ranges."""
    most, least = np.cos(np.maximum(angle_low - SLACK, 0)), np.cos(np.minimum(angle_high + SLACK, math.pi))
    slack = 1 + 1e-12 * anchor_norm * norm_high
    return (anchor_norm * least * np.where(least >= 0, norm_low, norm_high) - slack,
            anchor_norm * most * np.where(most >= 0, norm_high, norm_low) + slack)


def search(anchors: Block, rows: Block, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows by (score descending, id) with scores in the window [low, high] of each
    anchor and slot, among those of the same or of other labels: anchor, slot, row, score.
    `low` rises to the k-th score found."""
    n, dim = rows.data.shape
    top = float(np.abs(anchors.data).max(initial=0)) * float(np.abs(rows.data).max(initial=0)) * max(dim, 1)
    exact = top < 2**53
    edges = np.arange(0, n, TILE)
    norm_low, norm_high = np.minimum.reduceat(rows.norms, edges), np.maximum.reduceat(rows.norms, edges)
    angle_low, angle_high = np.zeros((len(anchors.ids), len(edges))), np.full((len(anchors.ids), len(edges)), math.pi)
    for j in range(rows.angles.shape[1]):
        own = anchors.angles[:, j][:, None]
        a, b = np.minimum.reduceat(rows.angles[:, j], edges), np.maximum.reduceat(rows.angles[:, j], edges)
        np.maximum(angle_low, np.maximum(own - b, a - own), out=angle_low)
        np.minimum(angle_high, np.minimum(own + b, 2 * math.pi - own - a), out=angle_high)
    least, most = score_bounds(angle_low, angle_high, anchors.norms[:, None], norm_low, norm_high)
    found: list[tuple[np.ndarray, ...]] = []
    waiting = 0

    def best() -> None:
        """Keeps the k best of each slot and raises `low` where there are k."""
        nonlocal found, waiting
        at, slot, row, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((row, rows.ids[row], -score, slot, at))
        at, slot, row, score = at[order], slot[order], row[order], score[order]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (slot[1:] != slot[:-1])))
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        full = place == k - 1
        low[at[full], slot[full]] = np.maximum(low[at[full], slot[full]], score[full])
        keep = place < k
        found, waiting = [(at[keep], slot[keep], row[keep], score[keep])], 0

    for t in np.argsort(-most.max(axis=0)).tolist():       # promising tiles first
        part = slice(t * TILE, min(n, (t + 1) * TILE))
        labels = rows.labels[part]
        meets = ((most[:, t][:, None] >= low) & (least[:, t][:, None] <= high) & (low <= high)).any(axis=1)
        if labels.min() == labels.max():
            meets &= (anchors.labels == labels[0]) == same
        picked = np.flatnonzero(meets)
        if not len(picked):
            continue
        fits = (anchors.labels[picked][:, None] == labels[None, :]) == same
        fits &= (anchors.owners[picked][:, None] != rows.number) | (anchors.places[picked][:, None] != np.arange(part.start, part.stop))
        floor, ceiling = low[picked].min(axis=1)[:, None], high[picked].max(axis=1)[:, None]
        if rows.angles.shape[1]:
            near, own = rows.angles[part][np.arange(len(labels)), rows.refs[part]], anchors.angles[picked][:, rows.refs[part]]
            lower, upper = score_bounds(np.abs(own - near), np.minimum(own + near, 2 * math.pi - own - near),
                                        anchors.norms[picked][:, None], rows.norms[part], rows.norms[part])
            fits &= (upper >= floor) & (lower <= ceiling)
        some, across = fits.any(axis=1), np.flatnonzero(fits.any(axis=0))
        if not len(across):
            continue
        picked, fits = picked[some], fits[some][:, across]
        score = _scores(anchors.data[picked], rows.data[part][across], exact)
        fits &= (score >= floor[some]) & (score <= ceiling[some])
        at, row = np.nonzero(fits)
        value, at, row = score[at, row], picked[at], across[row] + part.start
        inside = (value[:, None] >= low[at]) & (value[:, None] <= high[at])
        pair, slot = np.nonzero(inside)
        if len(pair):
            found.append((at[pair], slot, row[pair], value[pair]))
            waiting += len(pair)
            if waiting > max(4 * k * low.size, 1 << 12):
                best()
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    best()
    return found[0]


def _searched(anchors: DataFrame, blocks: DataFrame, groups: int, same: bool, k: int) -> DataFrame:
    """HITS of every block of anchors in every block of rows. Anchors come with the arrays low,
    high, positive_ids and positive_scores of `slots` windows each."""
    names = [c.split()[0] for c in BLOCKS.split(", ") if c.split()[0] != "dim"]
    windows = ["slots", "low", "high", "positive_ids"]
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "dim", *windows,
                           *[F.col(c).alias(f"a_{c}") for c in names])
    there = blocks.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), "dim",
                          *[F.col(c).alias(f"r_{c}") for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                asking, rows, slots = Block(row, "a_"), Block(row, "r_"), row["slots"].as_py()
                first, high, positive = (row[c].values.to_numpy(zero_copy_only=False).reshape(len(asking.ids), slots)
                                         for c in ("low", "high", "positive_ids"))
                low = carried.pop(asking.number, first.copy())
                at, slot, found, score = search(asking, rows, low, high, same, k)
                carried[asking.number] = low
                if len(carried) > CARRIED:
                    carried.popitem(last=False)
                columns = [np.full(len(at), asking.number), at, asking.ids[at], slot, positive[at, slot], high[at, slot],
                           rows.ids[found], score, np.full(len(at), rows.number), found]
                kinds = [pa.int32() if " int" in c else pa.int64() for c in HITS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)],
                                                 names=[c.split()[0] for c in HITS.split(", ")])

    hits = asked.hint("merge").join(there, ["group", "dim"]).mapInArrow(run, HITS)
    order = Window.partitionBy("a_block", "a_place", "slot").orderBy(F.desc("score"), "vec_id", "block", "place")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _anchors(blocks: DataFrame, every: int) -> DataFrame:
    """The rows of blocks whose id is divisible by `every`, with their places, as rows again."""
    schema = ROWS + ", own_block bigint, own_place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Block({name: batch.column(name)[i] for name in batch.schema.names}, "")
                at = np.flatnonzero(own.ids % every == 0)
                near = own.angles[at, own.refs[at]] if own.angles.shape[1] else np.zeros(len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), own.dim), pa.int32()), pa.array(own.ids[at]), pa.array(own.labels[at]),
                     pa.array(own.refs[at], pa.int32()), pa.array(near), pa.array(own.norms[at]),
                     pa.array(own.angles[at].tolist(), pa.list_(pa.float64())),
                     pa.array(own.data[at].tolist(), pa.list_(pa.int64())),
                     pa.array(np.full(len(at), own.number)), pa.array(at, pa.int32())],
                    names=[c.split()[0] for c in schema.split(", ")])

    return blocks.select(*[F.col(c.split()[0]) for c in BLOCKS.split(", ")]).mapInArrow(run, schema)


def _with_windows(anchors: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """Anchor blocks with a window for each positive of each anchor: scores from four fifths of
    the positive's to all of it. Anchors with fewer positives get windows that hold nothing."""
    listed = (positives.groupBy("a_block")
              .agg(F.collect_list(F.struct("a_place", "rank", "vec_id", "score")).alias("all"))
              .withColumnRenamed("a_block", "block"))      # ANCHORS * k at most
    schema = BLOCKS + ", slots int, low array<bigint>, high array<bigint>, positive_ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, n = batch.slice(i, 1), len(batch.column("ids")[i])
                low, high, ids = np.ones((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
                for p in batch.column("all")[i].as_py():
                    at = p["a_place"], p["rank"] - 1
                    low[at], high[at], ids[at] = p["score"] - p["score"] // 5, p["score"], p["vec_id"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c.split()[0]) for c in BLOCKS.split(", ")), pa.array([k], pa.int32()),
                     *(pa.array([x.ravel().tolist()], pa.list_(pa.int64())) for x in (low, high, ids))],
                    names=[c.split()[0] for c in schema.split(", ")])

    return anchors.hint("merge").join(listed, "block").mapInArrow(run, schema)


def _ranges(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The rows sorted within ranges of about `most` rows, or RANGES larger ones."""
    parts = max(1, min(RANGES, -(-df.count() // most)))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _groups(spark: SparkSession, blocks: int) -> int:
    """Groups that blocks are dealt to: no more copies of the anchors than tasks can use."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(blocks, tasks, GROUPS), -(-blocks // HELD))


def hard_negatives(vectors: DataFrame, k: int = 5, every: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each of
    the k best rows of an anchor's label, the k best rows of other labels whose score is at
    least four fifths of the positive's and no more than it."""
    spark = vectors.sparkSession
    rows = labelled(vectors, scale)
    stored = materialize(_stored(rows, references(rows)), "angles").withColumn("salt", F.monotonically_increasing_id())
    sorted_rows = _ranges(stored, ["dim", "ref", "label", "angle", "vec_id", "salt"], BLOCK).drop("salt")
    blocks = materialize(_blocks(sorted_rows, BLOCK), "vector_blocks")
    groups = _groups(spark, blocks.count())
    picked = materialize(_anchors(blocks, every), "anchor_rows")
    asking = _ranges(picked, ["dim", "ref", "label", "own_block", "own_place"], ANCHORS)
    anchors = materialize(_blocks(asking, ANCHORS), "anchor_blocks")
    open_windows = anchors.select(
        "*", F.lit(1).alias("slots"), *[F.array_repeat(F.lit(int(v)).cast("bigint"), F.size("ids")).alias(c)
                                        for c, v in (("low", LEAST), ("high", MOST), ("positive_ids", 0))])
    positives = materialize(_searched(open_windows, blocks, groups, True, k)
                            .select("a_block", "a_place", "rank", "vec_id", "score"), "positives")
    found = _searched(_with_windows(anchors, positives, k), blocks, groups, False, k)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))
