import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import colliding
from tokenizers import Tokenizer

from dataward.llm import packing

PARTS = [*"ab ,\n\té日'1Σ\u3000\u00a0\x85", "<|endoftext|>", "the ", "  "]
TOKENIZER = Tokenizer.from_file(packing.TOKENIZER)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_units_encode_as_whole_texts():
    texts = [None, "", " ", "a  b", " lead", "trail ", "a\n b", "it's <|endoftext|> x y", "<|endoftext|>", "日本 語 x",
             "é « x »", "a b 　 c", "\x1c \x85 z", "x" * 5000, "tab\tand 12 34.5", *colliding()]
    ids, off = packing.encoder(packing.TOKENIZER, packing.RANKS).encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == ids_of(text), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=4))
def test_any_text(texts):
    ids, off = packing.encoder(packing.TOKENIZER, packing.RANKS).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [ids_of(t) for t in texts]


def check(rows, texts, capacity):
    """rows: packed pieces; texts: doc -> list of its rows' texts."""
    places = defaultdict(list)
    docs = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
        assert 1 <= r["length"] <= capacity
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, own in texts.items():
        want = []
        for text in own:
            ids = np.array([*ids_of(text), packing.SEPARATOR], "<u4")
            cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            want += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
        got = [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in docs[doc]]
        assert sorted(got) == sorted(want)
    assert set(docs) == set(texts)


def test_every_piece_has_a_place(messy, nothing):
    texts = defaultdict(list)
    for r in messy.collect():
        texts[r["doc_id"]].append(r["text"])
    for capacity in (2048, 64):
        rows = packing.pack(messy, capacity).collect()
        check(rows, texts, capacity)
        total = sum(r["length"] for r in rows)
        assert len({r["sequence_id"] for r in rows}) <= -(-total // capacity) + 1
    assert packing.pack(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=30))
def test_plan(counts):
    slots = packing.plan(counts, 50)
    rooms = defaultdict(list)
    ends = {}
    for i in range(len(slots["rank"])):
        length, rank = int(slots["length"][i]), int(slots["rank"][i])
        later = [int(r) for n, r in zip(slots["length"], slots["rank"]) if n == length and r > rank]
        for k in range(min(later, default=counts[length]) - rank):
            rooms[int(slots["sequence"][i]) + k].append((int(slots["offset"][i]), length))
            ends[length] = ends.get(length, 0) + 1
    assert ends == counts
    for own in rooms.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 50
    left = []                                            # best fit, one piece after the other
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        best = min((i for i, room in enumerate(left) if room >= length), key=lambda i: left[i], default=None)
        if best is None:
            left.append(50 - length)
        else:
            left[best] -= length
    assert len(rooms) <= 1.02 * len(left) + 1
