import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stripewise.llm.packing import pack, sequences
from stripewise.llm.queries import vocabulary
from stripewise.llm.tokens import text_ids

SIGNS = st.sampled_from(list("ab 's\n\t  éß1,.!😀") + ["don't", "  ", " \n", " ", "\x1c", " ", "<|endoftext|>", " the"])


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(st.lists(SIGNS, max_size=30).map("".join))
def test_ids_equal_the_library(text):
    from tokenizers import Tokenizer

    global _T
    _T = globals().get("_T") or Tokenizer.from_file(vocabulary())
    got = np.frombuffer(text_ids(vocabulary()).ids(text), "<u4").tolist()
    assert got == _T.encode(text, add_special_tokens=False).ids


def test_round_trip(awkward, plain):
    got = pack(awkward, vocabulary(), window=64).collect()
    seqs = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == len(seqs.setdefault(r.sequence_id, []))
        assert len(r.ids) == 4 * r.length and r.offset + r.length <= 64
        seqs[r.sequence_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert sorted(seqs) == list(range(len(seqs)))
    assert all(len(seqs[k]) == 64 for k in sorted(seqs)[:-1])
    stream = [t for k in sorted(seqs) for t in seqs[k]]
    # The stream is the texts in some order, each closed by 0: no vocabulary id 0 ("!") occurs here.
    texts, one = [], []
    for t in stream:
        if t == 0:
            texts.append(one)
            one = []
        else:
            one.append(t)
    assert not one and sorted(texts) == sorted(plain(r.text or "") for r in awkward.collect())


def test_pieces_of_a_document(awkward):
    got = pack(awkward, vocabulary(), window=64).where("doc_id = 4").orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.length
    assert at == got[0].doc_tokens


def test_sequences_and_crc(docs_of):
    docs = docs_of([(1, "a b c", "s"), (2, None, "s"), (3, "d " * 40, "s")])
    pieces = pack(docs, vocabulary(), window=16)
    seqs = sequences(pieces, 16).orderBy("sequence_id").collect()
    assert all(len(s.ids) == 64 for s in seqs) and all(s.length == 16 for s in seqs[:-1])
    assert sum(s.length for s in seqs) == pieces.agg(F.sum("length")).first()[0]
    for r in pieces.select("ids", F.crc32("ids").alias("c")).collect():
        assert r.c == zlib.crc32(r.ids)


def test_empty(empty):
    assert pack(empty, vocabulary()).count() == 0
