import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import colliding
from sentencepiece import sentencepiece_model_pb2 as format

from dataward.llm import pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
PARTS = [*"abthe ing1'.!\n\té日Σ́ ▁ﬁ①㌀", "  ", "   ", "　", "<s>", "</s>", "<unk>", "<0x0A>", "\x00",
         " the", "\U0001f600", "اّ", "が", "が", "한국", "​", "﻿", "­"]
texts = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


def with_map(rule: str, **settings) -> bytes:
    """The model with the compiled character map of a rule of the library."""
    model = format.ModelProto()
    model.ParseFromString(open(pieces.MODEL, "rb").read())
    own = format.ModelProto()
    own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    for name, value in settings.items():
        setattr(model.normalizer_spec, name, value)
    return model.SerializeToString()


def same(own, library, rows):
    shown = list(own.texts(pa.array(rows, pa.string())))
    spans = list(own.encode(pa.array(rows, pa.string())))
    for text, (n, ids, decoded), (only, begin, end) in zip(rows, shown, spans):
        want = library.encode(text or "", add_eos=True)
        assert [int(i) for i in ids.split()] == want, repr(text)
        assert n == len(want) and only.tolist() == want[:-1]
        assert decoded == library.decode(want), repr(text)
        assert own.decode(want) == decoded
        proto = library.encode(text or "", return_type="proto")
        assert [(p.begin, p.end) for p in proto.pieces] == list(zip(begin, end)), repr(text)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.MODEL)


ODD = [None, "", " ", "  a", "a  ", "a   b", "\n", "x\ny", "▁", "▁▁a▁", "aaaa" * 30, "é" * 70, "日本 語", "q" * 3000,
       "\U0001f600\U0001f600 \U0001f600", "1234567890 12", "the the the", "\x00a\x00", " " * 50 + "x", "ab" * 400]


def test_odd_texts(own):
    same(own, LIBRARY, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, max_size=4))
def test_any_text(rows):
    same(pieces.pieces(pieces.MODEL), LIBRARY, rows)


@pytest.mark.parametrize("rule,squeeze,dummy", [
    ("nmt_nfkc", True, True), ("nfkc_cf", False, True), ("nmt_nfkc_cf", True, False), ("nmt_nfkc", False, False)])
def test_compiled_maps(rule, squeeze, dummy):
    data = with_map(rule, remove_extra_whitespaces=squeeze, add_dummy_prefix=dummy)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    mapped = pieces.Pieces(serialized=data)

    @settings(max_examples=20, deadline=None)
    @given(st.lists(texts, max_size=3))
    def check(rows):
        same(mapped, library, rows)

    check()
    same(mapped, library, ODD)


def test_merges_in_the_librarys_order(own):
    r = np.random.default_rng(5)
    names = [p for p in own.names[259:] if p.isascii()]
    rows = ["".join(r.choice(names, 9)) for _ in range(3000)] + ["".join(r.choice(list("aeinrst "), 60)) for _ in range(300)]
    for text, (_, ids, _) in zip(rows, own.texts(pa.array(rows))):
        assert [int(i) for i in ids.split()[:-1]] == LIBRARY.encode(text)


def test_bytes_that_are_no_text(own):
    ids = [own.bytes[0xE6].item(), own.bytes[0x41].item(), 22557, 1, own.bytes[0xFF].item(), 0, 2]
    assert own.decode(ids) == LIBRARY.decode(ids)


def test_equal_polynomial_hashes(own):
    same(own, LIBRARY, [*colliding(), " ".join(colliding())])


def test_forgetting_units(monkeypatch):
    few = pieces.Pieces(pieces.MODEL)
    few.units.limit = 3
    for _ in range(3):
        same(few, LIBRARY, ["some words here", "and others there", "some words here"])


def test_rows(messy, nothing):
    rows = pieces.digests(messy).collect()
    assert len(rows) == messy.count()
    by_id = {}
    for r in messy.collect():
        by_id.setdefault(r["doc_id"], []).append(LIBRARY.encode(r["text"] or "", add_eos=True))
    for r in rows:
        found = [(len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(),
                  hashlib.sha256(LIBRARY.decode(i).encode()).hexdigest()) for i in by_id[r["doc_id"]]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in found
    assert pieces.digests(nothing).count() == 0 and pieces.encode(nothing).count() == 0


def test_spans_give_the_text_back(messy):
    encoded = pieces.encode(messy.filter("doc_id IN (1, 7, 9)"))
    text = {r["doc_id"]: r["text"] for r in messy.filter("doc_id IN (1, 7, 9)").collect()}
    for r in encoded.collect():
        data = text[r["doc_id"]].encode()
        assert b"".join(data[a:b] for a, b in zip(r["begins"], r["ends"])) == data
    for r in pieces.decode(encoded).collect():
        assert r["text"] == text[r["doc_id"]]
