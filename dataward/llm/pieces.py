"""SentencePiece encoding and decoding that keeps the place of every piece in its text.

1. Normalisation. The model's compiled character map (a double-array trie of byte strings
   with their replacements) is walked from all characters of a slice at once, which gives
   the longest prefix at each; from left to right the matches that are used replace their
   bytes, other characters stay. White space follows the model's rules. Each normalised
   byte keeps the place of the source bytes it came from. A model without a map keeps all
   characters. The space symbol is held as one space byte throughout.
2. Merging. Normalised texts are cut where no piece can reach across (before a space after
   something else, around characters that stand in no longer piece). Each different unit is
   merged once: in every round the best pair of each unit, the leftmost of equals, becomes
   one symbol. Known units are looked up by hash.
3. Projection. The normalised sizes of a text's pieces, summed, give their places, and those
   give byte spans of the source; of an unknown character's byte pieces only the last one
   has a span.

Defined results. Null text: as empty: the end id alone, empty decoded text. Repeated rows and
doc_ids, null doc_ids: each row gets its own result. Empty table: no rows. Texts of control
symbols are ordinary text. Other columns are ignored. Models other than BPE, and those with
user-defined or unused pieces, white space as a suffix or unescaped, are refused.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from dataward.llm.words import ByteSpans, Numbering, slices

MODEL = public_tokenizers.path("piece_bpe_32k.model")
KNOWN_UNITS = 500_000       # per worker: about 400 bytes each
SLICE = 2 << 20
WIDTHS = (8, 16, 32)        # symbols of the units that are merged together; longer ones by a heap
SPACE = "▁"
_SPACE_BYTES = np.frombuffer(SPACE.encode(), np.uint8)
_SIDE = 1 << 21             # above every symbol: pieces, then code points that are none
_CHAR = 1 << 20             # code points without a piece of their own start here
_NEVER = np.iinfo(np.int64).max
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6      # kinds of pieces in model files


class CharacterMap:
    """The compiled map: trie units, then the replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4:4 + size], "<u4").astype(np.int64)
        self.replaced = np.frombuffer(compiled[4 + size:], np.uint8)

    @staticmethod
    def _step(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest key at each `start` that ends by `end` (0: none), and the
        place of its replacement."""
        length, value = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        if not len(self.units):
            return length, value
        alive, node = np.arange(len(start)), np.full(len(start), self._step(self.units[:1])[0])
        depth = 0
        while len(alive):
            inside = start[alive] + depth < end[alive]
            alive, node = alive[inside], node[inside]
            byte = buf[start[alive] + depth].astype(np.int64)
            node ^= byte
            known = node < len(self.units)
            alive, node, byte = alive[known], node[known], byte[known]
            unit = self.units[node]
            fits = (unit & ((1 << 31) | 255)) == byte
            alive, node, unit = alive[fits], node[fits], unit[fits]
            node ^= self._step(unit)
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            length[alive[leaf]] = depth
            value[alive[leaf]] = self.units[node[leaf]] & ((1 << 31) - 1)
        return length, value


class Normalised:
    """Normalised bytes of some texts: `buf`, `off` (texts), `origin` (source byte within its
    text, per byte) and `last` (source byte at which the normalised text ends, per text)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, origin: np.ndarray, last: np.ndarray):
        self.buf, self.off, self.origin, self.last = buf, off, origin, last


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after the other."""
    done = np.cumsum(size)
    return np.repeat(start - done + size, size) + np.arange(done[-1] if len(done) else 0)


def _kept(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """New offsets when only the flagged bytes stay."""
    return np.concatenate([[0], np.cumsum(flags)])[off]


class Normaliser:
    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces

    def _tokens(self, buf: np.ndarray, off: np.ndarray):
        """Start and size of the used prefixes, place and size of what stands for each; places
        count on from the source into the map's replacements."""
        start = np.flatnonzero((buf & 0xC0) != 0x80)
        size = np.diff(np.append(start, len(buf)))
        end = off[1:][np.searchsorted(off[1:], start, side="right")]
        length, value = self.map.longest(buf, start, end)
        if (length > size).any():                          # some characters are inside a used match
            used, free = np.ones(len(start), bool), 0
            wide = np.flatnonzero(length > size)
            stops = np.searchsorted(start, (start + length)[wide])
            for k, stop in zip(wide.tolist(), stops.tolist()):
                if k >= free:
                    used[k + 1:stop] = False
                    free = stop
            start, size, length, value = (x[used] for x in (start, size, length, value))
        hit = length > 0
        place, shown = start.copy(), size.copy()
        if hit.any():
            zeros = np.flatnonzero(self.map.replaced == 0)
            stop = zeros[np.searchsorted(zeros, value[hit])]
            place[hit] = len(buf) + value[hit]
            shown[hit] = stop - value[hit]
        return start, np.where(hit, length, size), place, shown

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> Normalised:
        n = len(off) - 1
        if len(self.map.units):
            start, _, place, shown = self._tokens(buf, off)
            out = np.concatenate([buf, self.map.replaced])[_ranges(place, shown)]
            origin = np.repeat(start, shown)
            token = np.repeat(np.arange(len(start)), shown)
            edges = np.searchsorted(start, off)
            out_off = np.concatenate([[0], np.cumsum(shown)])[edges]
        else:
            out, origin, out_off = buf, np.arange(len(buf)), off
            start, shown, edges, token = origin, np.ones(len(buf), np.int64), off, origin
        text = np.repeat(np.arange(n), np.diff(out_off))
        origin = origin - off[:-1][text]
        if not len(self.map.units) and len(buf):           # continuation bytes point at their character
            origin = np.maximum.accumulate(np.where((buf & 0xC0) != 0x80, np.arange(len(buf)), 0)) - off[:-1][text]
        head, last = np.zeros(n, np.int64), np.diff(off)   # source place of the first kept token, of the end
        empty = last == 0
        if self.squeeze:
            blank = out == 0x20
            first = np.cumsum(shown) - shown
            lone = np.zeros(len(start), bool)              # tokens that are one space
            single = shown == 1
            lone[single] = blank[first[single]]
            rest = np.concatenate([[0], np.cumsum(~lone)])
            at = np.searchsorted(rest, rest[edges[:-1]], side="right") - 1
            empty = rest[edges[1:]] == rest[edges[:-1]]
            head[~empty] = start[at[~empty]] - off[:-1][~empty]
            # a space at the head of a token goes if the last token with bytes ended in one
            inner = np.concatenate([[0], np.cumsum(~blank)])
            leading = blank & (inner[:-1] == inner[first[token]]) if len(out) else blank
            before = first[token] - 1                      # the byte before this byte's token
            opening = before < out_off[:-1][text]
            closed = np.ones(len(out), bool)
            closed[~opening] = blank[before[~opening]]
            keep = ~(leading & closed)
            out_off, out, origin, text = _kept(keep, out_off), out[keep], origin[keep], text[keep]
        if len(out) > 2 and (out == _SPACE_BYTES[0]).any():        # a written space symbol is a space
            own = np.flatnonzero((out[:-2] == _SPACE_BYTES[0]) & (out[1:-1] == _SPACE_BYTES[1])
                                 & (out[2:] == _SPACE_BYTES[2]))
            keep = np.ones(len(out), bool)
            keep[own + 1] = keep[own + 2] = False
            out = out.copy()
            out[own] = 0x20
            out_off, out, origin, text = _kept(keep, out_off), out[keep], origin[keep], text[keep]
        if self.squeeze:                                   # spaces at the end go
            solid = np.where(out != 0x20, np.arange(len(out)), -1)
            done = np.append(-1, np.maximum.accumulate(solid) if len(solid) else solid)[out_off[1:]]
            stop = np.where(done >= out_off[:-1], done + 1, out_off[:-1])
            cut = stop < out_off[1:]
            last = last.copy()
            last[cut] = origin[stop[cut]]
            blank_text = stop == out_off[:-1]
            last[blank_text & ~empty] = head[blank_text & ~empty]
            empty = empty | blank_text
            keep = np.arange(len(out)) < stop[text]
            out_off, out, origin, text = _kept(keep, out_off), out[keep], origin[keep], text[keep]
        if self.dummy:
            at = out_off[:-1][~empty]
            out, origin = np.insert(out, at, 0x20), np.insert(origin, at, head[~empty])
            out_off = out_off + np.concatenate([[0], np.cumsum(~empty)])
        return Normalised(out, out_off, origin, last)


class Pieces:
    """A model: its normaliser, its merges and the units that this worker has met."""

    def __init__(self, path: str | None = None, serialized: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as format

        model = format.ModelProto()
        model.ParseFromString(serialized if serialized is not None else open(path, "rb").read())
        spec, kinds = model.trainer_spec, [p.type for p in model.pieces]
        if (spec.model_type != format.TrainerSpec.BPE or spec.treat_whitespace_as_suffix
                or not model.normalizer_spec.escape_whitespaces
                or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("a BPE model with plain pieces and escaped white space is needed")
        self.normaliser, self.end, self.unknown = Normaliser(model.normalizer_spec), spec.eos_id, spec.unk_id
        self.kinds, self.unknown_text, self.fallback = np.array(kinds), spec.unk_surface, spec.byte_fallback
        self.names = [p.piece.replace(SPACE, " ") for p in model.pieces]
        self.bytes = np.zeros(256, np.int64)
        for i, kind in enumerate(kinds):
            if kind == BYTE:
                self.bytes[int(self.names[i][3:5], 16)] = i
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes)} if spec.byte_fallback else {}
        self.sizes = np.array([len(p.encode()) for p in self.names], np.int64)
        self.numbers = np.array([str(i) for i in range(len(kinds))], object)
        self.shown = np.array(self.names, object)
        self._tables(model)
        self.units = Numbering(KNOWN_UNITS)
        self._forget()

    def _tables(self, model) -> None:
        number = {name: i for i, (name, kind) in enumerate(zip(self.names, self.kinds)) if kind == NORMAL}
        longer = [name for name in number if len(name) > 1]
        inside = {c for name in longer for c in name}
        chars = sorted({c for name in number if len(name) == 1 for c in name})
        self.chars = np.array([ord(c) for c in chars], np.int64)
        self.char_symbols = np.array([number[c] for c in chars], np.int64)
        symbol = number | {c: _CHAR + ord(c) for c in inside if c not in number}
        # the best scores merge first; equal scores are one rank, so that the leftmost wins
        scores = sorted({model.pieces[number[name]].score for name in longer}, reverse=True)
        rank = {score: r for r, score in enumerate(scores)}
        found = {}
        for name in longer:
            for k in range(1, len(name)):
                a, b = symbol.get(name[:k]), symbol.get(name[k:])
                if a is not None and b is not None:
                    found[a * _SIDE + b] = (rank[model.pieces[number[name]].score], number[name])
        self.pair_keys = np.array(sorted(found), np.int64)
        self.pair_ranks, self.pair_makes = (np.array([found[k][i] for k in sorted(found)], np.int64)
                                            for i in (0, 1))
        self.cut_spaces = not any(re.search("[^ ] ", name) for name in longer)
        self.alone = np.zeros(256, bool)
        self.alone[:128] = [chr(c) not in inside for c in range(128)]

    def _forget(self) -> None:
        self.units.clear()
        self.ids, self.spent, self.at = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.id_texts = self.decoded = np.zeros(0, object)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of symbol pairs; those that make no piece come last."""
        key = left * _SIDE + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        fits = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0) if len(self.pair_keys) else at < 0
        if not len(self.pair_keys):
            return np.full(key.shape, _NEVER), at
        return np.where(fits, self.pair_ranks[at], _NEVER), self.pair_makes[at]

    def _merge_rounds(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, filled with -1 at the end, merged to the end."""
        out, row = symbols.copy(), np.arange(len(symbols))
        rank, made = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while len(row):
            best = rank.argmin(axis=1)                     # the leftmost of equals
            more = rank[np.arange(len(row)), best] != _NEVER
            if not more.all():
                out[row[~more]] = symbols[~more]
                row, symbols, rank, made, best = row[more], symbols[more], rank[more], made[more], best[more]
            if not len(row):
                break
            line, width = np.arange(len(row)), symbols.shape[1]
            symbols[line, best] = made[line, best]
            source = np.arange(1, width)[None, :] + (np.arange(width - 1) >= best[:, None])
            source[source == width] = width - 1
            shifted = np.take_along_axis(symbols, source, 1)
            shifted[:, -1] = -1
            symbols[:, 1:] = shifted
            keep = np.arange(width - 1)[None, :] + (np.arange(width - 1) >= best[:, None])
            gone = keep >= width - 1
            keep[gone] = width - 2
            rank, made = np.take_along_axis(rank, keep, 1), np.take_along_axis(made, keep, 1)
            rank[gone] = _NEVER
            for at in (best - 1, best):                    # the pairs beside the new symbol
                ok = (at >= 0) & (at < width - 1)
                rank[line[ok], at[ok]], made[line[ok], at[ok]] = self._pairs(
                    symbols[line[ok], at[ok]], symbols[line[ok], at[ok] + 1])
        return out

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One long unit, through a heap of pairs by rank and place."""
        own, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = (x.tolist() for x in self._pairs(symbols[:-1], symbols[1:]))
        heap = [(r, k, m, own[k], own[k + 1]) for k, (r, m) in enumerate(zip(rank, made)) if r != _NEVER]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def add(a: int, b: int) -> None:
            pair = own[a], own[b]
            if pair not in known:
                found = self._pairs(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = int(found[0][0]), int(found[1][0])
            r, m = known[pair]
            if r != _NEVER:
                heapq.heappush(heap, (r, a, m, *pair))

        while heap:
            _, a, m, x, y = heapq.heappop(heap)
            b = after[a]
            if own[a] != x or b >= n or own[b] != y:       # changed since
                continue
            own[a], own[b] = m, -1
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
                add(a, after[a])
            if before[a] >= 0:
                add(before[a], a)
        return np.array([s for s in own if s >= 0], np.int64)

    def _merged(self, points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units after merging and their number per unit; `points` are the code
        points of the units, `counts` of them in each."""
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        symbols = np.where(self.chars[at] == points, self.char_symbols[at], _CHAR + points)
        first = np.cumsum(counts) - counts
        out, sizes, low = np.full(len(points), -1), np.zeros(len(counts), np.int64), 0
        for width in WIDTHS:
            own = np.flatnonzero((counts > low) & (counts <= width))
            low = width
            if not len(own):
                continue
            table = np.full((len(own), width + 1), -1, np.int64)
            line = np.repeat(np.arange(len(own)), counts[own])
            table[line, _ranges(np.zeros(len(own), np.int64), counts[own])] = symbols[_ranges(first[own], counts[own])]
            table = self._merge_rounds(table)
            live = table >= 0
            sizes[own] = live.sum(axis=1)
            out[_ranges(first[own], sizes[own])] = table[live]
        for k in np.flatnonzero(counts > low).tolist():
            merged = self._merge_long(symbols[first[k]:first[k] + counts[k]])
            sizes[k] = len(merged)
            out[first[k]:first[k] + len(merged)] = merged
        return out[out >= 0], sizes

    def _expanded(self, symbols: np.ndarray, counts: np.ndarray):
        """Ids, normalised bytes that each stands for, and ids per unit."""
        odd = np.flatnonzero(symbols >= _CHAR)
        if not len(odd):
            return symbols, self.sizes[symbols], counts
        unit = np.repeat(np.arange(len(counts)), counts)
        own = [chr(s - _CHAR).encode() for s in symbols[odd].tolist()]
        size = np.ones(len(symbols), np.int64)
        if self.fallback:
            size[odd] = [len(b) for b in own]
        spent = np.zeros(len(symbols), np.int64)
        plain = symbols < _CHAR
        spent[plain] = self.sizes[symbols[plain]]
        spent[odd] = [len(b) for b in own]
        ids = np.repeat(np.where(plain, symbols, self.unknown), size)
        last = np.cumsum(size) - 1
        out = np.zeros(len(ids), np.int64)
        out[last] = spent
        if self.fallback:
            ids[_ranges(last[odd] + 1 - size[odd], size[odd])] = self.bytes[np.frombuffer(b"".join(own), np.uint8)]
        return ids, out, np.bincount(unit, weights=size, minlength=len(counts)).astype(np.int64)

    def _learn(self, data: bytes, counts: np.ndarray) -> None:
        points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4").astype(np.int64)
        ids, spent, sizes = self._expanded(*self._merged(points, counts))
        at = self.at[-1] + np.cumsum(sizes)
        edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        gc.disable()                                       # many small objects, no cycles
        numbers, shown = self.numbers[ids].tolist(), self.shown[ids].tolist()
        texts = [" ".join(numbers[a:b]) for a, b in zip(edges, edges[1:])]
        plain = ["".join(shown[a:b]) for a, b in zip(edges, edges[1:])]
        for k in np.unique(np.repeat(np.arange(len(sizes)), sizes)[self.kinds[ids] != NORMAL]).tolist():
            plain[k] = self.decode(ids[edges[k]:edges[k + 1]].tolist(), head=False)
        gc.enable()
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.spent = np.concatenate([self.spent, spent.astype(np.int32)])
        self.at = np.concatenate([self.at, at])
        self.id_texts = np.concatenate([self.id_texts, np.array(texts, object)])
        self.decoded = np.concatenate([self.decoded, np.array(plain, object)])

    def _units(self, t: Normalised) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of the units of normalised texts."""
        buf = t.buf
        cut = np.zeros(len(buf) + 1, bool)
        cut[t.off] = True
        if self.cut_spaces:
            cut[1:-1] |= (buf[1:] == 0x20) & (buf[:-1] != 0x20)
        alone = self.alone[buf]
        cut[:-1] |= alone
        cut[1:] |= alone
        edges = np.flatnonzero(cut)
        start, end = edges[:-1], edges[1:]
        return start, end, np.searchsorted(t.off[1:], start, side="right")

    def _looked_up(self, t: Normalised) -> tuple[np.ndarray, np.ndarray]:
        """Number of each unit of the texts and the text it is in; new ones are learned."""
        if self.units.full():
            self._forget()
        start, end, doc = self._units(t)
        number, new = self.units.look_up(ByteSpans(t.buf).of(start, end))
        if len(new):
            a, b = start[new], end[new]
            heads = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
            self._learn(t.buf[_ranges(a, b - a)].tobytes(), heads[b] - heads[a])
        return number, doc

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Per text: the number of ids, the ids joined by spaces, the decoded text."""
        t = self.normaliser(*_bytes(texts))
        number, doc = self._looked_up(t)
        total = np.bincount(doc, weights=np.diff(self.at)[number], minlength=len(texts)).astype(np.int64)
        off = np.searchsorted(doc, np.arange(len(texts) + 1))
        for k in range(len(texts)):
            own = number[off[k]:off[k + 1]]
            ids = self.id_texts[own].tolist()
            first = (i for u in own for i in self.ids[self.at[u]:self.at[u + 1]])
            shown = "".join(self.decoded[own].tolist())[self._prefix(first):]
            yield int(total[k]) + 1, " ".join([*ids, str(self.end)]), shown

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: ids without an end id, and the byte span of each in the source."""
        t = self.normaliser(*_bytes(texts))
        number, doc = self._looked_up(t)
        counts = np.diff(self.at)[number]
        source = _ranges(self.at[:-1][number], counts)
        ids, spent = self.ids[source], self.spent[source].astype(np.int64)
        stop = np.cumsum(spent)
        edges = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=counts, minlength=len(texts)))]).astype(np.int64)
        for k in range(len(texts)):
            a, b = edges[k], edges[k + 1]
            origin = np.append(t.origin[t.off[k]:t.off[k + 1]], t.last[k])
            end = stop[a:b] - t.off[k]
            begin = end - spent[a:b]
            hidden = spent[a:b] == 0                       # byte pieces before the last of a character
            yield ids[a:b], origin[begin], np.where(hidden, origin[begin], origin[end])

    def _prefix(self, ids: Iterable[int]) -> int:
        """How many spaces at the head of a decoded text come from the dummy prefix: that of the
        first piece, and where white space is squeezed also those of pieces before any text."""
        n = 0
        for i in ids:
            if self.kinds[i] == CONTROL:
                continue
            if self.kinds[i] != NORMAL or self.names[i][0] != " " or not (self.normaliser.dummy or self.normaliser.squeeze):
                break
            n += 1
            if not self.normaliser.squeeze or self.names[i] != " ":
                break
        return n

    def decode(self, ids: list[int], head: bool = True) -> str:
        """The text of some ids; `head`: they begin a text, so a first space goes."""
        parts, run = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                parts.append(_decoded(bytes(run)))
                run.clear()
            kind = self.kinds[i]
            if kind != CONTROL:
                parts.append(self.unknown_text if kind == UNKNOWN else self.names[i])
        if run:
            parts.append(_decoded(bytes(run)))
        return "".join(parts)[self._prefix(ids) if head else 0:]


def _decoded(data: bytes) -> str:
    """Bytes as text; each byte that is in no character becomes a replacement character."""
    try:
        return data.decode()
    except UnicodeDecodeError as error:
        return data[:error.start].decode() + "�" + _decoded(data[error.start + 1:])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts (null: empty) and their offsets in it."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _key(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and, per piece, its id and the bytes of the text that it stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                found = list(pieces(model).encode(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"),
                     *(pa.array([r[i] for r in found], pa.list_(kind))
                       for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64())))],
                    names=["doc_id", "ids", "begins", "ends"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"{_key(docs)}, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of its ids; null ids give null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else pieces(model).decode([i for i in ids if i is not None])
                     for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"{_key(encoded)}, text string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, number of ids with the end id, SHA-256 of the ids and of the decoded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                rows = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                        for n, ids, text in pieces(model).texts(part.column("text"))]
                n, ids, texts = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                     pa.array(texts, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"{_key(docs)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
