"""Exact top-k inner-product search with the threshold algorithm.

Vectors become blocks of at most `BLOCK` rows, written once. A task takes a block of
queries and a block of candidates: each dimension's list is sorted, all lists are read
from both ends to growing depths, rows met for the first time are scored exactly, and a
query leaves once its k-th score is above the bound for anything unread (the sum over
dimensions of the best product still possible). The k best of each block are merged by
rank. Every query block meets every candidate block through a join on block groups.

Defined results. A vector that is null, holds a null or a non-finite component, or has no
id takes no part. Vectors of different lengths never meet. A row's own vector is excluded
by row, so another row with the same vec_id is a candidate; ties beyond vec_id are between
equal rows. Empty table: no rows. Other columns are ignored. Scores must fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataward.session import materialize

BLOCK = 4096
QUERIES = 1024              # most queries in one block
FIRST_DEPTH = 32            # list positions read first; then four times as many each time
NOTHING = np.iinfo(np.int64).min + 1     # score of no row
BLOCKS = "block bigint, dim int, ids array<bigint>, places array<int>, data binary"
HITS = ("query_block bigint, query_place int, query_id bigint, vec_id bigint, score bigint, "
        "block bigint, place int")


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of each component, for vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
            .select(F.col("vec_id").cast("bigint"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
                    .alias("vector")))


def _as_blocks(vectors: DataFrame, most: int) -> DataFrame:
    """Blocks of rows of one dimension, each row with its id and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}

        def block(dim: int, rows: list) -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            data = np.array([v for _, v in rows], np.int64).reshape(len(rows), dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([serial]), pa.array([dim], pa.int32()), pa.array([[i for i, _ in rows]]),
                 pa.array([list(range(len(rows)))], pa.list_(pa.int32())), pa.array([data.tobytes()])],
                names=["block", "dim", "ids", "places", "data"])

        for batch in batches:
            for key, vector in zip(batch.column("vec_id").to_pylist(),
                                   batch.column("vector").to_numpy(zero_copy_only=False)):
                own = waiting.setdefault(len(vector), [])
                own.append((key, vector))
                if len(own) == most:
                    yield block(len(vector), waiting.pop(len(vector)))
        for dim, rows in waiting.items():
            yield block(dim, rows)

    return vectors.mapInArrow(run, BLOCKS)


def _query_blocks(blocks: DataFrame, every: int) -> DataFrame:
    """The rows of each block whose id is divisible by `every`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array(row["ids"], np.int64)
                picked = np.flatnonzero(ids % every == 0)
                data = np.frombuffer(row["data"], np.int64).reshape(len(ids), row["dim"])
                for own in np.split(picked, range(QUERIES, len(picked), QUERIES)) if len(picked) else []:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]]), pa.array([row["dim"]], pa.int32()),
                         pa.array([ids[own].tolist()], pa.list_(pa.int64())),
                         pa.array([own.tolist()], pa.list_(pa.int32())), pa.array([data[own].tobytes()])],
                        names=["block", "dim", "ids", "places", "data"])

    return blocks.mapInArrow(run, BLOCKS)


def _products(queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; by floating point where no sum can lose a unit."""
    if exact:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def threshold_search(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray):
    """The k best rows of each query by (score descending, id ascending): arrays of row
    numbers and scores, -1 where there are fewer. `own` is the row to leave out, or -1."""
    n, dim = rows.shape
    top = np.abs(queries).max(initial=0).astype(float) * np.abs(rows).max(initial=0).astype(float) * max(dim, 1)
    exact = top < 2**53
    lists = np.argsort(rows, axis=0, kind="stable")        # ascending list of each dimension
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    best = np.full((len(queries), k), -1, np.int64)
    score = np.full((len(queries), k), NOTHING)
    active, seen = np.arange(len(queries)), np.zeros(n, bool)
    depth = 0
    while len(active):
        read, depth = depth, min(n, depth * 4 or FIRST_DEPTH)
        met = np.unique(np.concatenate([lists[read:depth].ravel(), lists[n - depth:n - read].ravel()])) \
            if dim else np.arange(n)
        met = met[~seen[met]]
        seen[met] = True
        if len(met):
            found = _products(queries[active], rows[met], exact)
            number = np.concatenate([best[active], np.broadcast_to(met, found.shape)], axis=1)
            value = np.concatenate([score[active], found], axis=1)
            value[number == own[active][:, None]] = NOTHING
            number[value == NOTHING] = -1
            if value.shape[1] > 4 * k:                     # all that reach the k-th score, ties too
                kth = np.partition(value, value.shape[1] - k, axis=1)[:, -k]
                wide = int((value >= kth[:, None]).sum(axis=1).max())
                if wide < value.shape[1] // 2:
                    keep = np.argpartition(value, value.shape[1] - wide, axis=1)[:, -wide:]
                    number, value = (np.take_along_axis(x, keep, 1) for x in (number, value))
            tie = np.where(number >= 0, ids[number], np.iinfo(np.int64).max)
            order = np.lexsort((tie, -value), axis=1)[:, :k]
            best[active] = np.take_along_axis(number, order, 1)
            score[active] = np.take_along_axis(value, order, 1)
        if depth >= n or not dim or seen.all():
            break
        # what is unread lies, in every list, between positions depth and n - depth
        bound = (_products(up[active], rows[lists[n - 1 - depth], np.arange(dim)][None, :], exact)
                 + _products(down[active], rows[lists[depth], np.arange(dim)][None, :], exact))[:, 0]
        active = active[score[active, k - 1] <= bound]     # an equal score could have a smaller id
    return best, score


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k best other vectors of each vector whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    parts = max(1, -(-rows.count() // BLOCK))
    blocks = materialize(_as_blocks(rows.repartition(parts), BLOCK), "vector_blocks")
    groups = max(1, min(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sides = [
        _query_blocks(blocks, every).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))),
        blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")),
    ]
    sides = [side.select("group", "dim", *[F.col(c).alias(f"{name}_{c}") for c in ("block", "ids", "places", "data")])
             for name, side in zip("qc", sides)]
    pairs = reduce(lambda a, b: a.join(b, ["group", "dim"]), sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                dim = row["dim"].as_py()
                ids, qids, places = (row[c].values.to_numpy() for c in ("c_ids", "q_ids", "q_places"))
                rows, queries = (np.frombuffer(row[c].as_py(), np.int64).reshape(m, dim)
                                 for c, m in (("c_data", len(ids)), ("q_data", len(qids))))
                block, query_block = row["c_block"].as_py(), row["q_block"].as_py()
                own = places.astype(np.int64) if block == query_block else np.full(len(qids), -1)
                best, score = threshold_search(queries, rows, ids, k, own)
                q, at = np.nonzero(best >= 0)
                place = best[q, at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), query_block)), pa.array(places[q], pa.int32()), pa.array(qids[q]),
                     pa.array(ids[place]), pa.array(score[q, at]), pa.array(np.full(len(q), block)),
                     pa.array(place, pa.int32())],
                    names=[c.split()[0] for c in HITS.split(", ")])

    hits = pairs.mapInArrow(run, HITS)
    order = (Window.partitionBy("query_block", "query_place")
             .orderBy(F.desc("score"), "vec_id", "block", "place"))
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
