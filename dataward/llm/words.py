"""Words, lines and their 64-bit hashes for slices of an Arrow text column.

A slice's texts lie in one byte buffer; every step is a few numpy passes over it, so no
Python object is made per word. Byte spans are hashed in pieces of eight bytes, each mixed
with its place, so that no regular strings collide; runs of word hashes are polynomials of
those modulo 2**64, taken from prefix sums (any run costs O(1)).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACES = 0xD1B54A32D192ED03

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per worker and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:                       # doubling: out[done:2*done] = out[:done] * base**done
            step = min(done, size - done)
            out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if n > SLICE_BYTES * 8:                  # one giant text must not stay in memory
            return out
        _powers[base] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHashes:
    """Hashes of spans [start, end) of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, base: int = _BASE):
        n = len(codes)
        self.base = base
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(base, max(n, 1))[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(pow(self.base, -1, 1 << 64), len(self.sums))
        value = (self.sums[end] - self.sums[start]) * back[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class ByteSpans:
    """Hashes of byte spans: the sum of their mixed eight-byte pieces, mixed with the length.
    A piece is mixed with its place first, so equal sums of different spans are chance."""

    def __init__(self, buf: np.ndarray):
        self.padded = np.append(buf, np.zeros(8, np.uint8))
        self.eights = np.ndarray(len(buf) + 1, np.dtype("<u8"), self.padded, strides=(1,))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        pieces = (size + 7) >> 3
        first = np.cumsum(pieces) - pieces
        place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
        at = np.repeat(start, pieces) + 8 * place
        value = self.eights[at]
        short = np.flatnonzero(np.repeat(end, pieces) - at < 8)      # the last piece of a span
        left = (np.repeat(end, pieces)[short] - at[short]).astype(np.uint64)
        value[short] &= (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1)
        places = mix(np.arange(1, int(pieces.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(_PLACES))
        value = mix(value ^ places[place])
        total = np.zeros(len(size), np.uint64)
        filled = pieces > 0
        if filled.any():
            total[filled] = np.add.reduceat(value, first[filled])
        return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Texts:
    """The words of a slice of texts: `start`, `end` (bytes) and `doc` (row) per word."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        self.n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + self.n + 1] \
            if self.n else np.zeros(1, np.int64)
        data = texts.buffers()[2] if self.n else None
        self.buf = (np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
                    if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8))
        self.off = off = offsets - offsets[0]
        self.is_word = word = ~_SPACE[self.buf]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = off[:-1][off[:-1] < len(word)]
        first[inner] = word[inner]
        ends = off[1:][off[1:] > 0] - 1
        last[ends] = word[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off[1:], self.start, side="right")
        self.counts = np.bincount(self.doc, minlength=self.n)[:self.n]

    def byte_hashes(self) -> ByteSpans:
        return ByteSpans(self.buf)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.off[1:]] - sums[self.off[:-1]]

    def lines(self):
        """Start, end and text of each \\n-separated line."""
        breaks = np.flatnonzero(self.buf == 10)
        start = np.sort(np.concatenate([self.off[:-1], breaks + 1]))
        end = np.sort(np.concatenate([self.off[1:], breaks]))
        return start, end, np.repeat(np.arange(self.n), self.per_text(self.buf == 10) + 1)

    def text(self, start: int, end: int) -> str:
        return self.buf[start:end].tobytes().decode()


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes in a text or binary column each, or one row if
    that is longer."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
    total = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def aside(docs: DataFrame, own: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with all columns but `own` under names that no operator uses, and the function
    that gives rows their names back."""
    names = {c: c if c in own else f"other{i}" for i, c in enumerate(docs.columns)}

    def back(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(n).alias(c) for c, n in names.items()])

    return docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in names.items()]), back


class Numbering:
    """Numbers 64-bit keys in order of first sight; forgets all beyond `limit` keys, so the
    memory of a long-lived worker is bounded."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.numbers, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def full(self) -> bool:
        return self.size > self.limit

    def look_up(self, keys: np.ndarray):
        """Number of each key, and the positions in `keys` of those that are new."""
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == unique[known]
        number = np.empty(len(unique), np.int64)
        number[known] = self.numbers[at[known]]
        number[~known] = self.size + np.arange(np.count_nonzero(~known))
        if not known.all():
            self.size += int(np.count_nonzero(~known))
            self.keys = np.insert(self.keys, at[~known], unique[~known])
            self.numbers = np.insert(self.numbers, at[~known], number[~known])
        return number[inverse], first[~known]
