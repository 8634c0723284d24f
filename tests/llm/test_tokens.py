import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cases import MESSY, documents, empty
from kinrank.llm import bpe as B
from kinrank.llm import token_count as C
from kinrank.llm.queries import _tokenizer

WORD, BYTE = _tokenizer("word_bpe_49k.json"), _tokenizer("byte_bpe_50k.json")
LIBRARY, OWN, COUNTER = Tokenizer.from_file(WORD), B.Bpe(WORD), C.load(BYTE)
SPECIAL = "<|endoftext|>"
TEXTS = [*MESSY, f"a{SPECIAL}b <|startoftext|>{SPECIAL}", "DON'T we'Ll it's 'RE", "x" * 700, "tion" * 400, "é" * 300,
         "\x1c\x1d a\x85b\xa0c", "Ünïcödé ǅ Σς ﬁ １２ ٣ 漢字 🙂👍", "é Å", "<|endoftext", "à" * 3]
pieces = st.one_of(st.text(max_size=30), st.sampled_from([SPECIAL, "<|endof", " \n ", "'ll ", "straße ", "1234", "the the "]))


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=8).map("".join))
def test_bpe_equals_the_library(text):
    ids, decoded = OWN.encode(text)
    assert (np.frombuffer(ids, "<u4").tolist(), decoded) == library(text)
    assert OWN.decode(np.frombuffer(ids, "<u4").tolist()) == decoded


def test_scan_and_heap_merge_alike():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 60, 127):
        for letters in (b"ab", b"the ino"[:3] + b"ino", bytes(range(97, 123))):
            word = bytes(rng.choice(list(letters), n).tolist())
            ids = [OWN.inner[b] for b in word[:-1]] + [OWN.final[word[-1]]]
            assert OWN._scan(list(ids)) == OWN._heap(list(ids))


def test_bpe_jobs(spark):
    docs = documents(spark, TEXTS)
    rows = {r.doc_id: r for r in B.digests(docs, WORD).collect() if r.doc_id is not None}
    full = B.encode(docs, WORD)
    assert full.count() == docs.count()
    lists = {r.doc_id: r for r in full.collect() if r.doc_id is not None}
    for i, t in enumerate(TEXTS):
        ids, decoded = library(t)
        assert (lists[i].ids, lists[i].decoded) == (ids, decoded)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert B.digests(empty(spark), WORD).count() == 0 and B.encode(empty(spark), WORD).count() == 0


def whole(text):
    return len(COUNTER.encode(text, add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=60).map("".join), st.integers(34, 90), st.integers(1, 40))
def test_spliced_counts_equal_whole_counts(text, chunk, overlap):
    assert C.count_tokens(COUNTER, text, chunk, overlap) == whole(text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "ab " * 3000, "\n" * 999 + "x", SPECIAL * 300, "!" * 2000 + "b " * 99])
def test_splicing_hard_texts(text):
    for chunk, overlap in ((64, 8), (300, 64)):
        assert C.count_tokens(COUNTER, text, chunk, overlap) == whole(text)


def test_token_count_job(spark):
    docs = documents(spark, TEXTS)
    for chunk in (C.CHUNK, 200):
        rows = {r.doc_id: r for r in C.token_counts(docs, BYTE, chunk=chunk, overlap=32).collect() if r.doc_id is not None}
        for i, t in enumerate(TEXTS):
            assert (rows[i].n_bytes, rows[i].n_tokens) == (len((t or "").encode()), whole(t or ""))
            assert rows[i].over_limit == (whole(t or "") > 512)
    assert C.token_counts(empty(spark), BYTE).count() == 0
