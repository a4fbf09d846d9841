"""BPE encoding and decoding through a pair occurrence index.

Texts are cut into words at white space, where the tokenizer cuts too. The words of a
slice that the worker has not met are normalised, cut into pretokens and merged together:
an index maps each pair of neighbouring symbols to all its positions, the lowest rank is
taken from a heap, its positions are merged from left to right, and the lists of the
pairs that appear beside a merge are extended. Known words are looked up by hash.

Defined results. Null text: as empty: no tokens, empty decoded text. Repeated rows and
doc_ids, null doc_ids: each row gets its own result. Empty table: no rows. The text of a
special token is that token wherever it stands, as in the tokenizers library. Other
columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm.words import Numbering, Texts, slices

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
KNOWN_WORDS = 1_000_000     # per worker: about 200 bytes each
SLICE = 4 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = [(self.vocab[a], self.vocab[b]) for a, b in pairs]
        self.made = [self.vocab[a + b] for a, b in pairs]
        keys = np.array(self.pairs, np.int64) @ np.array([len(self.vocab), 1])
        self.pair_ranks = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_ranks]
        size = max(self.tokens) + 1
        self.numbers = np.array([str(i) for i in range(size)], object)
        self.names = np.array([self.tokens.get(i, "") for i in range(size)], object)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern, regex.V0)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        shown = byte_characters()
        self.inner = np.array([self.vocab[c] for c in shown])
        self.last = np.array([self.vocab[c + self.suffix] for c in shown])
        self.words = Numbering(KNOWN_WORDS)
        self._forget()

    def _forget(self) -> None:
        self.words.clear()
        self.counts = np.zeros(0, np.int64)
        self.id_texts = self.token_texts = np.zeros(0, object)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs, -1 where they do not merge."""
        key = left * len(self.vocab) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def merge(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pretokens and the offsets of each, merged through one index."""
        data = [p.encode() for p in pretokens]
        end = np.cumsum([len(d) for d in data], dtype=np.int64)
        codes = np.frombuffer(b"".join(data), np.uint8)
        n = len(codes)
        symbols = np.append(self.inner[codes], -1)         # position n stands for none
        symbols[end - 1] = self.last[codes[end - 1]]
        following, before = np.arange(1, n + 2), np.arange(-1, n)
        following[end - 1] = n
        before[0] = n
        before[end[:-1]] = n
        positions: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            rank = self._rank(left, right)
            some = rank >= 0
            at, rank = at[some], rank[some]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, own in zip(rank[np.append(0, edges)].tolist() if len(rank) else [], np.split(at, edges)):
                if r not in positions:
                    positions[r] = []
                    heapq.heappush(active, r)
                positions[r].append(own)

        add(np.arange(n), symbols[:n], symbols[following[:n]])
        while active:
            rank = heapq.heappop(active)
            a, b = self.pairs[rank]
            at = np.unique(np.concatenate(positions.pop(rank)))
            at = at[(symbols[at] == a) & (symbols[following[at]] == b)]  # else merged otherwise
            if a == b:                                     # of overlapping pairs the left one merges
                used, free = -1, []
                for p, q in zip(at.tolist(), following[at].tolist()):
                    if p != used:
                        free.append(p)
                        used = q
                at = np.array(free, np.int64)
            gone = following[at]
            symbols[at], symbols[gone] = self.made[rank], -1
            after = following[at] = following[gone]
            before[after] = at
            left = before[at]
            add(np.concatenate([at, left]), np.concatenate([symbols[at], symbols[left]]),
                np.concatenate([symbols[after], symbols[at]]))
        live = symbols[:n] >= 0
        off = np.concatenate([[0], np.cumsum(live)])[np.concatenate([[0], end])]
        return symbols[:n][live], off

    def _pretokens(self, words: list[str]) -> list[list[str]]:
        # no final-sigma rule here: characters are lowered one by one
        plain = unicodedata.normalize("NFC", "\n".join(words)).replace("Σ", "σ").lower().split("\n")
        return [[w] if w.isalpha() else self.split.findall(w) for w in plain]

    def _learn(self, words: list[str]) -> None:
        """Texts of ids and tokens of new words without ASCII white space."""
        odd = {i for i, w in enumerate(words) if "<|" in w and self.specials.search(w)}
        parts = self._pretokens(["" if i in odd else w for i, w in enumerate(words)])
        for i in odd:                                      # each special token is a part of its own
            own, at = [], 0
            for m in self.specials.finditer(words[i]):
                own += [*self._pretokens([words[i][at:m.start()]])[0], m[0]]
                at = m.end()
            parts[i] = own + self._pretokens([words[i][at:]])[0]
        shown = {s: (1, str(i), s) for s, i in self.special.items()} if odd else {}
        fresh = list(dict.fromkeys(p for own in parts for p in own if p not in shown))
        if fresh:
            ids, off = self.merge(fresh)
            numbers, tokens, off = self.numbers[ids].tolist(), self.names[ids].tolist(), off.tolist()
            for p, a, b in zip(fresh, off, off[1:]):
                shown[p] = (b - a, " ".join(numbers[a:b]), " ".join(tokens[a:b]))
        counts, texts, tokens = [], [], []
        for own in parts:
            n, text, names = shown[own[0]] if own else (0, "", "")
            for p in own[1:]:
                more = shown[p]
                n, text, names = n + more[0], f"{text} {more[1]}", f"{names} {more[2]}"
            counts.append(n)
            texts.append(text)
            tokens.append(names)
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)])
        self.id_texts = np.concatenate([self.id_texts, np.array(texts, object)])
        self.token_texts = np.concatenate([self.token_texts, np.array(tokens, object)])

    def encode(self, texts: pa.Array):
        """Per text: the number of tokens, the ids joined by spaces, the decoded text (without
        a decoder the library joins the tokens by spaces)."""
        t = Texts(texts)
        if self.words.full():
            self._forget()
        number, new = self.words.look_up(t.byte_hashes().of(t.start, t.end))
        if len(new):
            gc.disable()                                   # many small objects, no cycles
            self._learn([t.text(a, b) for a, b in zip(t.start[new], t.end[new])])
            gc.enable()
        counts = self.counts[number]
        if not counts.all():                               # words that give no token
            number, doc = number[counts > 0], t.doc[counts > 0]
        else:
            doc = t.doc
        off = np.searchsorted(doc, np.arange(t.n + 1))
        total = np.bincount(doc, weights=self.counts[number], minlength=t.n).astype(np.int64)
        for k in range(t.n):
            own = number[off[k]:off[k + 1]]
            yield int(total[k]), " ".join(self.id_texts[own].tolist()), " ".join(self.token_texts[own].tolist())


@lru_cache(2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ids and decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                rows = list(bpe(tokenizer).encode(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"),
                     pa.array([[int(i) for i in r[1].split()] for r in rows], pa.list_(pa.int32())),
                     pa.array([r[2] for r in rows], pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, number of tokens, SHA-256 of the ids and of the decoded text. The digests are
    taken beside the encoder, so that neither crosses to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                rows = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                        for n, ids, text in bpe(tokenizer).encode(part.column("text"))]
                n, ids, texts = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                     pa.array(texts, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id"), "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, "
             "ids_sha256 string, decoded_sha256 string")
