"""Language identification by cross-parsing.

A suffix automaton per language holds every substring of that language's sample. A text is
parsed greedily into the longest phrases the sample contains; a language that explains it
needs few. Phrases are normalised to bits per character, phrases * log2(sample size) /
length, and the smallest value wins. Automata are dense transition tables, so a task walks
thousands of text blocks at once, one character per step.

Parsing starts anew every `BLOCK` characters (one phrase more per block, in every
language alike), which lets long texts be parsed in parallel; all characters count.

The sample is bounded: per language `SAMPLE_DOCS` documents, chosen by a hash of doc_id,
and of each a stretch of `SAMPLE_CHARS` characters at a place that the hash chooses.

Defined results. Null text or text without a letter: `und`, score 0; so is every text
where nothing could be learned. Case, digits, punctuation and white space do not matter.
Rows without lang or doc_id teach nothing. Repeated rows: each gets its result. Ties go to
the smaller language name. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataward.llm.words import slices

SAMPLE_DOCS = 64
SAMPLE_CHARS = 400
BLOCK = 512
UNKNOWN = "und"
_POINTS = 0x110000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """At most n_docs stretches of text per language, from rows that are not held out."""
    number = F.xxhash64("doc_id")
    room = F.greatest(F.length("text") - n_chars, F.lit(0))
    rows = (docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & F.col("doc_id").isNotNull() & ~held_out())
            .select("lang", number.alias("number"),
                    F.substring("text", F.pmod(number, room + 1).cast("int") + 1, F.lit(n_chars)).alias("part")))
    order = Window.partitionBy("lang").orderBy("number", "part")
    picked = (rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_docs)
              .select("lang", "part").collect())       # n_docs * n_chars characters per language
    out: dict[str, list[str]] = {}
    for row in sorted(picked):
        out.setdefault(row["lang"], []).append(row["part"])
    return out


class Alphabet:
    """Character classes: 0 for runs of anything but letters, 1 for letters outside the
    samples, one class for each other letter, whatever its case."""

    def __init__(self, texts: list[str]):
        seen = sorted({c.lower() for t in texts for c in set(t) if c.isalpha() and len(c.lower()) == 1})
        known = {c: i + 2 for i, c in enumerate(seen)}
        self.size = len(seen) + 2
        table = np.zeros(_POINTS, np.int32)
        for point in range(_POINTS):
            c = chr(point)
            if c.isalpha():
                table[point] = known.get(c.lower(), 1)
        self.table = table

    def read(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def automaton(sequences: list[np.ndarray], size: int) -> np.ndarray:
    """Transitions of the suffix automaton of the sequences: `target * size * 2 + flag`, where
    the flag says that the phrase ended and the walk goes on from the root."""
    step: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    for sequence in sequences:
        last = 0                                       # the next sequence starts at the root
        for c in sequence.tolist():
            if c in step[last]:
                q = step[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[last] + 1)
                link.append(link[q])
                link[q] = clone
                p = last
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                last = clone
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = clone
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
            last = new
    table = np.full((len(step), size), -1, np.int64)
    for state, own in enumerate(step):
        for c, target in own.items():
            table[state, c] = target
    restart = np.maximum(table[0], 0) * size * 2 + 1
    return np.where(table >= 0, table * size * 2, restart).astype(np.int32).ravel()


class Model:
    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        self.alphabet = Alphabet([t for own in texts.values() for t in own])
        self.tables, self.bits = [], []
        for lang in self.langs:
            read = [self._squeeze(self.alphabet.read(t)) for t in texts[lang]]
            self.tables.append(automaton(read, self.alphabet.size))
            self.bits.append(math.log2(2 + sum(map(len, read))))

    @staticmethod
    def _squeeze(classes: np.ndarray) -> np.ndarray:
        keep = np.ones(len(classes), bool)
        keep[1:] = (classes[1:] > 0) | (classes[:-1] > 0)
        return classes[keep]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        joined = "".join(t or "" for t in texts)
        off = np.concatenate([[0], np.cumsum([len(t or "") for t in texts], dtype=np.int64)])
        classes = self.alphabet.read(joined)
        letters = np.concatenate([[0], np.cumsum(classes > 0)])[off]
        some = np.diff(letters) > 0
        keep = np.ones(len(classes), bool)
        keep[1:] = (classes[1:] > 0) | (classes[:-1] > 0)
        keep[off[:-1][off[:-1] < len(keep)]] = True
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        costs = self._bits_per_character(classes[keep], off)
        score = np.zeros(len(texts))
        lang = [UNKNOWN] * len(texts)
        if self.langs:
            best = costs.argmin(axis=0)
            share = 2.0 ** -(costs - costs.min(axis=0))
            score = np.where(some, 1 / share.sum(axis=0), 0.0)
            lang = [self.langs[b] if s else UNKNOWN for b, s in zip(best, some)]
        return lang, score

    def _bits_per_character(self, classes: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        sizes = np.diff(off)
        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(n), blocks)
        first = np.cumsum(blocks) - blocks
        start = off[doc] + (np.arange(len(doc)) - first[doc]) * BLOCK
        length = np.minimum(BLOCK, off[doc + 1] - start)
        order = np.argsort(-length, kind="stable")     # blocks still running are a prefix
        start, length, doc = start[order], length[order], doc[order]
        running = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        out = np.zeros((len(self.langs), n))
        states = [np.zeros(len(start), np.int32) for _ in self.langs]
        phrases = [np.ones(len(start), np.int32) for _ in self.langs]
        for t, k in enumerate(running.tolist()):
            now = classes[start[:k] + t]
            for state, count, table in zip(states, phrases, self.tables):
                state = state[:k]
                state += now
                went = table[state]
                count[:k] += went & 1
                np.right_shift(went, 1, out=state)
        for i, bits in enumerate(self.bits):
            out[i] = np.bincount(doc, weights=phrases[i], minlength=n) * bits / np.maximum(sizes, 1)
        return out


def without_mislabelled(texts: dict[str, list[str]]) -> dict[str, list[str]]:
    """The sample without stretches that a model of the other half gives another language.
    A language of which nothing would be left keeps its sample."""
    halves = [{lang: own[k::2] for lang, own in texts.items() if own[k::2]} for k in (0, 1)]
    out: dict[str, list[str]] = {lang: [] for lang in texts}
    for mine, other in (halves, halves[::-1]):
        model = Model(other)
        for lang, own in mine.items():
            said = model.predict(own)[0]
            out[lang] += [t for t, s in zip(own, said) if s in (lang, UNKNOWN) or lang not in other]
    return {lang: out[lang] or own for lang, own in texts.items()}


def fit(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_chars: int = SAMPLE_CHARS) -> Model:
    return Model(without_mislabelled(sample(docs, n_docs, n_chars)))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # bounded per language
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()),
                     pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, f"doc_id {key}, held_out boolean, lang_pred string, score double")
