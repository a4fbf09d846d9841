import hashlib
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import colliding
from tokenizers import Tokenizer

from dataward.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.TOKENIZER)


PARTS = [*"abthe ing1'.!\n\té日Σ\u0301\u00a0", "<|endoftext|>", "'s", " the"]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


def same(texts):
    got = list(bpe.bpe(bpe.TOKENIZER).encode(pa.array(texts, pa.string())))
    for text, own in zip(texts, got):
        assert own == expected(text), repr(text)


def test_odd_texts():
    same([None, "", " ", "a  b", "x<|startoftext|>y <|endoftext|>", "aaaa aaa aaaaa", "I'LL it's ΑΣ ΟΔΟΣ İ", "é é",
          "日本 語", "\x1c \x85 z\x00", "12ab!!??", "<|", "a b​c", "q" * 3000, "\U0001f600 \U0001f600\U0001f600", " ".join(colliding())])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), max_size=4))
def test_any_text(texts):
    same(texts)


def test_rows(messy, nothing):
    rows = bpe.digests(messy).collect()
    assert len(rows) == messy.count()
    texts = {}
    for r in messy.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for r in rows:
        found = [(n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
                 for n, i, d in map(expected, texts[r["doc_id"]])]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in found
    assert bpe.digests(nothing).count() == 0


def test_round_trip(messy):
    for r in bpe.encode(messy.filter("doc_id IN (1, 7, 9)")).collect():
        text = messy.filter(f"doc_id = {r['doc_id']}").first()["text"]
        spoken = "".join(r["decoded"].split(" ")).replace("</w>", " ")
        back = {c: b for b, c in enumerate(bpe.byte_characters())}
        data = bytes(back[c] if c != " " else 32 for c in spoken)
        plain = unicodedata.normalize("NFC", text).lower()
        assert data.decode().split() == plain.split()
