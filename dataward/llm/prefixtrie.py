"""Prefix tries of conversations, as double arrays over shards of the sorted conversations.

1. A turn is a digest of its role and text, so texts are read once and never shuffled. The
   turns of a conversation, in order, are one row; equal sequences become one, with the
   number, the smallest and a digest of their conversations. That digest is made over
   packed runs of sorted ids, so a sequence shared by a third of all rows is spread too.
2. Different sequences are dealt by range into shards, so that sequences with a common prefix
   stand together and a prefix of any size is split. A shard numbers its turns densely and
   packs its trie, level by level, into BASE and CHECK: the child of state s by turn t is
   BASE[s] + t, if CHECK there is s. Walking the sequences gives the nodes and their members,
   and one pass from the deepest level up the sums over subtrees.
3. Only prefixes of a shard's first and last sequence can be in another shard. These upper
   nodes go out with the sums of what only that shard has below them, are merged by the
   digest of their path, and folded from the deepest up in one stream of at most
   2 * shards * (longest conversation + 1) rows.

Defined results. Null role or text: as empty. Null turns come first; turns of a conversation
with equal numbers come in the order of their digests, repeated rows are turns of their own.
Null conv_id: no conversation. Empty table: no rows, not even a root. Other columns are
ignored. A conversation has to fit into a task, at 40 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.session import materialize

SHARD = 500_000             # turns in a shard, about
RUN = 1 << 16               # characters of packed ids that travel as one row
TRIES = 64                  # free places tried for the children of a node before new ones are taken
FEW = 200_000               # upper nodes that may be broadcast, 200 bytes each
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: digest (key) and code points (chars) of each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn"), key.alias("key"), F.length(text).cast("bigint").alias("chars")).alias("one"))
    listed = F.sort_array(F.collect_list("one"))           # nulls first
    return (rows.groupBy("conv_id").agg(listed.alias("all"))
            .select("conv_id", F.transform("all", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars")))
                    .alias("turns")))


def rebuilt(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that begin like the first one of their group: crc32 of the decimal id
    modulo `heads` turns of it, then their own turns after as many."""
    own = materialize(turns(conversations), "conversations")
    first = (own.filter(F.col("conv_id") % group == 0)
             .select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("head")))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    return (own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), 1, n),
                                        F.slice("turns", n + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns")))


def _members(sequences: DataFrame) -> DataFrame:
    """(seq, n, low, ends) of the conversations (seq, conv_id): their number, the smallest and
    the SHA-256 of their ids, ascending and joined by commas."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, size = None, [], 0

        def run() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([seq], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([",".join(map(str, ids))])], names=["seq", "first", "n", "ids"])

        for batch in batches:
            done = []
            for own, i in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (own != seq or size > RUN):
                    done.append(run())
                    ids, size = [], 0
                seq = own
                ids.append(i)
                size += len(str(i)) + 1
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if ids:
            yield run()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, n, low, state = None, 0, None, None
        names = ["seq", "n", "low", "ends"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows = []
            for own, first, count, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "first", "n", "ids"))):
                if own != seq:
                    if seq is not None:
                        rows.append((seq, n, low, state.hexdigest()))
                    seq, n, low, state = own, 0, first, hashlib.sha256()
                state.update((("," if n else "") + ids).encode())
                n += count
            if rows:
                yield made(rows)
        if seq is not None:
            yield made([(seq, n, low, state.hexdigest())])

    runs = (sequences.select("seq", "conv_id").repartitionByRange("seq", "conv_id")
            .sortWithinPartitions("seq", "conv_id").mapInArrow(pack, "seq binary, first bigint, n bigint, ids string"))
    return (runs.repartition("seq").sortWithinPartitions("seq", "first")
            .mapInArrow(digest, "seq binary, n bigint, low bigint, ends string"))


class DoubleArray:
    """A trie of sorted sequences of dense ids: `ids`, and `off` where each sequence begins."""

    def __init__(self, ids: np.ndarray, off: np.ndarray):
        self.base, self.check = np.zeros(16, np.int64), np.full(16, -1, np.int64)
        self.check[0] = 0                                  # the root is its own parent
        self.top, self.low = 1, 1                          # ends of the used places, first that may be free
        size = np.diff(off)
        state = np.zeros(len(size), np.int64)
        for depth in range(int(size.max(initial=0))):
            here = np.flatnonzero(size > depth)
            parent, turn = state[here], ids[off[here] + depth]
            new = np.ones(len(here), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (turn[1:] != turn[:-1])
            self._place(parent[new], turn[new])
            state[here] = self.child(parent, turn)

    def child(self, state: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The states reached from `state` by `turn`; all of them must be there."""
        found = self.base[state] + turn
        if (self.check[found] != state).any():
            raise ValueError("a sequence leaves the trie")
        return found

    def _room(self, places: int) -> None:
        if places > len(self.check):
            more = max(places, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, parent: np.ndarray, turn: np.ndarray) -> None:
        """Packs new nodes, the children of one parent next to each other in the input."""
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        count = np.diff(np.append(first, len(parent)))
        for k in first[count > 1][np.argsort(-count[count > 1], kind="stable")].tolist():
            n = int(count[np.searchsorted(first, k)])
            own = np.sort(turn[k:k + n])
            low, span = int(own[0]), int(own[-1] - own[0]) + 1
            self._room(self.top + span)
            free = self.low + np.flatnonzero(self.check[self.low:min(self.top, self.low + 64 * TRIES)] < 0)[:TRIES]
            at = next((s for s in free.tolist() if s + span <= len(self.check)
                       and (self.check[s + own - low] < 0).all()), self.top)
            self._take(np.array([parent[k]]), np.array([at - low]), own, np.repeat(parent[k], n))
        single = first[count == 1]
        if len(single):
            self._room(self.top + len(single))
            free = self.low + np.flatnonzero(self.check[self.low:self.top + len(single)] < 0)[:len(single)]
            self._take(parent[single], free - turn[single], turn[single], parent[single])
            self.low = int(free[-1]) + 1

    def _take(self, state: np.ndarray, base: np.ndarray, turn: np.ndarray, parent: np.ndarray) -> None:
        self.base[state] = base
        place = self.base[parent] + turn
        self.check[place] = parent
        self.top = max(self.top, int(place.max()) + 1)


def _dense(keys: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense numbers of turn keys in the order in which the levels of the trie meet them, so
    that the children of a node have close numbers."""
    size = np.diff(off)
    depth = np.arange(len(keys)) - np.repeat(off[:-1], size)
    unique, inverse = np.unique(keys, return_inverse=True)
    order = np.argsort(depth, kind="stable")
    met = np.full(len(unique), len(keys))
    np.minimum.at(met, inverse[order], np.arange(len(keys)))
    number = np.empty(len(unique), np.int64)
    number[np.argsort(met)] = np.arange(len(unique))
    return number[inverse], len(unique)


NODES = ("upper boolean, key binary, parent_key binary, parent_conv_id bigint, conv_id bigint, depth int, "
         "n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, chars bigint, ends string")


def shard_nodes(keys: np.ndarray, chars: np.ndarray, off: np.ndarray, n: np.ndarray, low: np.ndarray,
                ends: list[str]) -> dict[str, list]:
    """The nodes of one shard of sorted different sequences, by the columns of NODES. An upper
    node counts as its own only what hangs below it on children that are not upper."""
    ids, different = _dense(keys, off)
    trie = DoubleArray(ids, off)
    chars_of = np.zeros(different, np.int64)
    chars_of[ids] = chars
    places = trie.top
    count, least = np.zeros(places, np.int64), np.full(places, np.iinfo(np.int64).max)
    turn, upper = np.zeros(places, np.int64), np.zeros(places, bool)
    ended: dict[int, str] = {}
    size, state = np.diff(off), np.zeros(len(off) - 1, np.int64)
    levels = [np.zeros(1, np.int64)]
    path: dict[int, tuple[bytes, bytes | None]] = {0: (hashlib.sha256(b"").digest(), None)}
    sides = sorted({0, len(size) - 1})
    depth = 0
    while True:                                            # walk all sequences, one level at a time
        here = np.flatnonzero(size >= depth)
        if not len(here):
            break
        if depth:
            step = ids[off[here] + depth - 1]
            before = state[here]
            state[here] = trie.child(before, step)
            turn[state[here]] = step
            levels.append(np.unique(state[here]))
            for k in sides:
                if size[k] >= depth:
                    above = path[int(before[np.searchsorted(here, k)])][0]
                    path.setdefault(int(state[k]), (hashlib.sha256(above + keys[off[k] + depth - 1]).digest(), above))
        np.add.at(count, state[here], n[here])
        np.minimum.at(least, state[here], low[here])
        for k in np.flatnonzero(size == depth).tolist():
            ended[int(state[k])] = ends[k]
        depth += 1
    upper[list(path)] = True
    children, leaves, saved = (np.zeros(places, np.int64) for _ in range(3))
    for level in levels[:0:-1]:                            # from the deepest up
        own = level[~upper[level]]
        leaves[own[children[own] == 0]] = 1
        saved[own] += (count[own] - 1) * chars_of[turn[own]]
        for total, value in ((children, 1), (leaves, leaves[own]), (saved, saved[own])):
            np.add.at(total, trie.check[own], value)
    state = np.concatenate(levels)
    parent = trie.check[state]
    depths = np.repeat(np.arange(len(levels)), [len(x) for x in levels])
    chars_here = np.where(state > 0, chars_of[turn[state]] if different else 0, 0)
    named, places_of = upper[state].tolist(), state.tolist()
    return {
        "upper": named, "key": [path[s][0] if u else None for s, u in zip(places_of, named)],
        "parent_key": [path[s][1] if u else path[p][0] if up else None for s, p, u, up in
                       zip(places_of, parent.tolist(), named, upper[parent].tolist())],
        "parent_conv_id": [None if up else v for v, up in zip(least[parent].tolist(), upper[parent].tolist())],
        "conv_id": least[state].tolist(), "depth": depths.tolist(), "n_convs": count[state].tolist(),
        "n_children": children[state].tolist(), "n_leaves": leaves[state].tolist(), "saved": saved[state].tolist(),
        "chars": chars_here.tolist(), "ends": [ended.get(s) for s in places_of]}


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    lists = table.column("turns").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    off = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values
    keys = np.array(values.field("key").to_pylist()[off[0]:off[-1]], "S32")
    chars = values.field("chars").to_numpy(zero_copy_only=False)[off[0]:off[-1]].astype(np.int64)
    found = shard_nodes(keys, chars, off - off[0], table.column("n").to_numpy(),
                        table.column("low").to_numpy(), table.column("ends").to_pylist())
    schema = pa.schema([("upper", pa.bool_()), ("key", pa.binary()), ("parent_key", pa.binary()),
                        ("parent_conv_id", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int32()),
                        *((c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved", "chars")),
                        ("ends", pa.string())])
    yield from pa.table(found, schema).to_batches(max_chunksize=10_000)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged upper nodes, deepest first: adds to each what its upper children hold."""
    waiting: dict[bytes, list[int]] = {}
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            children, leaves, saved = waiting.pop(r["key"], (0, 0, 0))
            r["n_children"] += children
            r["n_leaves"] = max(1, r["n_leaves"] + leaves)       # without children it is a leaf itself
            r["saved"] += saved + (r["n_convs"] - 1) * r["chars"]
            if r["parent_key"] is not None:
                above = waiting.setdefault(r["parent_key"], [0, 0, 0])
                for i, value in enumerate((1, r["n_leaves"], r["saved"])):
                    above[i] += value
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, turns)."""
    spark = conversations.sparkSession
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.base64(t["key"])), "").cast("binary"), 256)
    whole = materialize(conversations.select("conv_id", F.unhex(digest).alias("seq"), "turns"), "sequences")
    members = _members(whole)
    sequences = materialize(members.join(whole.select("conv_id", "turns"), F.col("low") == F.col("conv_id"))
                            .select("turns", "n", "low", "ends"), "sequences")
    size = sequences.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    found = materialize(sequences.repartitionByRange(shards, "turns").sortWithinPartitions("turns")
                        .mapInArrow(_shard, NODES), "trie_nodes")

    def any_of(name: str) -> Column:
        return F.any_value(name).alias(name)

    merged = (found.filter("upper").groupBy("key")
              .agg(any_of("parent_key"), any_of("depth"), any_of("chars"), F.min("conv_id").alias("conv_id"),
                   *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
                   F.max("ends").alias("ends")))
    top = materialize(merged.repartition(1).sortWithinPartitions(F.desc("depth"))
                      .mapInArrow(_folded, merged.schema), "upper_nodes")
    named = top.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    named = F.broadcast(named) if top.count() <= FEW else named
    columns = [F.col(c) for c in ("n_convs", "n_children", "n_leaves")] + [
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")]
    below = found.filter("NOT upper")
    rest = [below.filter("parent_key IS NULL").select("conv_id", "depth", "parent_conv_id", *columns)]
    rest += [part.join(named, "parent_key", "left").select("conv_id", "depth", F.col("above").alias("parent_conv_id"), *columns)
             for part in (below.filter("parent_key IS NOT NULL"), top)]
    return rest[0].union(rest[1]).union(rest[2]).withColumn("depth", F.col("depth").cast("bigint"))
