"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

1. Texts are tokenised once, in Arrow batches; only piece lengths and checksums go on.
2. A histogram of piece lengths (at most `capacity` numbers) reaches the driver, which
   plans by best fit over counts: lengths in descending order, each into the tightest
   gaps, whole runs of equal sequences at a time. Work and plan size depend on the
   capacity, not on the number of documents.
3. Pieces are ranked within their length and look their slot up by rank. A length held by
   many pieces is ranked in `SALTS` independent parts whose offsets come from the counts.

Defined results. Null text: as empty, a document of the separator alone. Repeated rows,
doc_ids used twice and null doc_ids: each row is a document of its own. Empty table: no
rows. Very long texts are cut into pieces, the first being the shorter one. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataward.llm.words import Numbering, Texts, slices
from dataward.session import materialize

CAPACITY = 2048
SEPARATOR = 0
SALTS = 64
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")   # the same vocabulary as ranks
KNOWN_UNITS = 2_000_000     # per worker: about 30 bytes each
SLICE = 4 << 20


class UnitEncoder:
    """Token ids of whole texts. A text is cut before every single space between two visible
    characters: the tokenizer's own splitting always cuts there too, so the units between
    cuts can be encoded apart, each different unit once."""

    def __init__(self, tokenizer: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        table = {base64.b64decode(a): int(b)
                 for a, b in map(bytes.split, open(ranks, "rb"))}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=table, special_tokens={})
        self.token_bytes = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            self.token_bytes[i] = len(token)
        self.units = Numbering(KNOWN_UNITS)
        self._forget()

    def _forget(self) -> None:
        self.units.clear()
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode_unit(self, unit: str) -> list[int]:
        # the two libraries' character classes surely agree on Latin letters
        if max(unit) < "ɐ" and not any(s in unit for s in self.special):
            return self.plain.encode_ordinary(unit)
        return self.whole.encode(unit, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the offsets of each text."""
        t = Texts(texts)
        if self.units.full():
            self._forget()
        start, end, doc = self._units(t)
        number, new = self.units.look_up(t.byte_hashes().of(start, end))
        self._learn(t, start[new], end[new])
        counts = (self.at[1:] - self.at[:-1])[number]
        done = np.cumsum(counts)
        source = np.repeat(self.at[number] - done + counts, counts) + np.arange(done[-1] if len(done) else 0)
        per_text = np.bincount(doc, weights=counts, minlength=t.n).astype(np.int64)[:t.n]
        return self.ids[source], np.concatenate([[0], np.cumsum(per_text)])

    def _learn(self, t: Texts, start: np.ndarray, end: np.ndarray) -> None:
        """Encodes new units. Those that begin with a space and end visibly are encoded as
        one text: the tokenizer cuts between them, and its cuts are found by token sizes."""
        if not len(start):
            return
        buf = np.append(t.buf, np.uint8(0))
        high = np.concatenate([[0], np.cumsum(t.buf > 0xC8)])
        solid = ((buf > 0x20) & (buf < 0x7F)) | ((buf >= 0xC3) & (buf <= 0xC8))
        tail = end - 1 - (buf[end - 1] >= 0x80)
        joint = ((high[end] == high[start]) & (end - start > 2) & (buf[start] == 0x20)
                 & solid[start + 1] & solid[tail])
        if joint.any() and any(s in t.text(0, len(t.buf)) for s in self.special):
            joint &= ~np.array([any(s in t.text(a, b) for s in self.special)
                                for a, b in zip(start, end)])
        sizes = (end - start) * joint
        done = np.cumsum(sizes)
        picked = t.buf[np.repeat(start - done + sizes, sizes) + np.arange(done[-1])]
        ids = np.array(self.plain.encode_ordinary(picked.tobytes().decode()), np.uint32)
        edges = np.searchsorted(np.cumsum(self.token_bytes[ids]), done, side="right")
        counts = np.diff(edges, prepend=0)
        if not joint.all():
            others = [self.encode_unit(t.text(a, b)) for a, b in zip(start[~joint], end[~joint])]
            counts[~joint] = [len(x) for x in others]
            out = np.empty(counts.sum(), np.uint32)
            own = np.repeat(~joint, counts)
            out[~own] = ids
            out[own] = [i for x in others for i in x]
            ids = out
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])

    def _units(self, t: Texts):
        buf = t.buf
        visible = buf > 0x20
        visible &= buf != 0x7F
        cut = np.zeros(len(buf), bool)
        if len(buf) > 2:
            cut[1:-1] = (buf[1:-1] == 0x20) & visible[:-2] & visible[2:]
            # Unicode spaces start with these bytes; a cut beside one is left out
            lead = np.isin(buf, (0xC2, 0xE1, 0xE2, 0xE3))
            cut[:-1] &= ~lead[1:]
            cut[2:] &= buf[:-2] != 0xC2
            three = np.isin(buf, (0xE1, 0xE2, 0xE3))
            cut[3:] &= ~three[:-3]
        filled = t.off[:-1] < t.off[1:]
        cut[t.off[:-1][filled]] = True
        start = np.flatnonzero(cut)
        doc = np.searchsorted(t.off[1:], start, side="right")
        odd = [i for i, s in self._with_special(t)]
        if odd:
            keep = ~np.isin(doc, odd) | np.isin(start, t.off[:-1])
            start, doc = start[keep], doc[keep]
        return start, np.append(start[1:], len(buf))[:len(start)], doc

    def _with_special(self, t: Texts):
        whole = t.buf.tobytes()
        for s in self.special:
            at = whole.find(s.encode())
            while at >= 0:
                yield int(np.searchsorted(t.off[1:], at, side="right")), s
                at = whole.find(s.encode(), at + 1)


@lru_cache(2)
def encoder(tokenizer: str, ranks: str) -> UnitEncoder:
    return UnitEncoder(tokenizer, ranks)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, __salt int"


def pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR,
           tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """Tokenises (doc_id, text) and cuts it: one row per piece, with a salt that spreads
    every length evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, turn = encoder(tokenizer, ranks), TaskContext.get().partitionId() * 7
        end = np.array([separator], np.uint32)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                ids, off = enc.encode(part.column("text"))
                rows = []
                for key, a, b in zip(part.column("doc_id").to_pylist(), off[:-1], off[1:]):
                    own = np.concatenate([ids[a:b], end]).tobytes()
                    total, at, k = len(own) // 4, 0, 0
                    to = total % capacity or capacity
                    while at < total:
                        turn += 1
                        rows.append((key, k, at, to - at, zlib.crc32(own[4 * at:4 * to]), turn % SALTS))
                        at, to, k = to, to + capacity, k + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "__salt"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best fit over counts. Runs of ranks [rank, next run) of a length go to consecutive
    sequences from `sequence` on, all at the same `offset`."""
    gaps: dict[int, list[tuple[int, int]]] = {}       # free room -> runs (first sequence, how many)
    out, used = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:                            # open as many as these pieces can fill
                fresh = -(-left // (capacity // length))
                gap, gaps[capacity] = capacity, [(used, fresh)]
                used += fresh
            first, n = gaps[gap].pop()
            take = min(n, left)
            if take < n:
                gaps[gap].append((first + take, n - take))
            if not gaps[gap]:
                del gaps[gap]
            out.append((length, rank, first, capacity - gap))
            if gap > length:
                gaps.setdefault(gap - length, []).append((first, take))
            left, rank = left - take, rank + take
    table = np.array(out, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def pack(docs: DataFrame, capacity: int = CAPACITY, **settings) -> DataFrame:
    """Each piece of each document with the sequence and offset where it goes."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, **settings), "pieces")
    parts = cut.groupBy("length", "__salt").agg(F.count("*").alias("n")).collect()  # <= capacity * SALTS
    counts: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for row in sorted(parts):
        base[row["length"], row["__salt"]] = counts.get(row["length"], 0)
        counts[row["length"]] = counts.get(row["length"], 0) + row["n"]
    slots = plan(counts, capacity)
    lengths = slots["length"]
    order = np.lexsort((slots["rank"], lengths))
    slots = {k: v[order] for k, v in slots.items()}
    first = {int(n): (int(np.searchsorted(slots["length"], n)), int(np.searchsorted(slots["length"], n, "right")))
             for n in np.unique(lengths)}
    shared = spark.sparkContext.broadcast((slots, base, first))  # bounded by the capacity
    by_length = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("__rank", F.row_number().over(by_length) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, base, first = shared.value
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy() for c in ("length", "__salt", "__rank"))
            rank = rank.astype(np.int64)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.lexsort((salt, length))
            edges = np.flatnonzero(np.diff(length[order] * SALTS + salt[order])) + 1
            for rows in np.split(order, edges) if len(order) else []:
                n = int(length[rows[0]])
                a, b = first[n]
                mine = rank[rows] + base[n, int(salt[rows[0]])]
                run = a + np.searchsorted(slots["rank"][a:b], mine, side="right") - 1
                sequence[rows] = slots["sequence"][run] + mine - slots["rank"][run]
                offset[rows] = slots["offset"][run]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, "
                                    "ids_crc32 bigint, sequence_id bigint, offset bigint")
