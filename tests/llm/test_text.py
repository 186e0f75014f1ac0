import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import text as tx

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t,😀", max_size=30)), max_size=8))
def test_equal_words_and_only_those_have_equal_hashes(texts):
    doc, word = tx.word_hashes(pa.array(texts, type=pa.string()), tx.SPACED)
    expected = [(k, w) for k, t in enumerate(texts) for w in WORDS.findall(lower(t or ""))]
    assert doc.tolist() == [k for k, _ in expected]
    names = {}
    for h, (_, w) in zip(word.tolist(), expected):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_pieces_do_not_change_tokens(monkeypatch):
    texts = pa.array(["ab cd, ef" * 9, None, "x" * 50 + " y", "", "é!! ü"] * 3)
    whole = tx.word_hashes(texts, tx.SPLIT)
    for size in (7, 16, 31):
        monkeypatch.setattr(tx, "PIECE", size)
        cut = tx.word_hashes(texts, tx.SPLIT)
        assert all(np.array_equal(a, b) for a, b in zip(whole, cut))


@pytest.mark.parametrize("words", [1, 4, 5])
def test_shingles_are_runs_of_words(words):
    texts = ["a b c d e f a b c d", "a b", "", None, "a  B\nc D e", "b"]
    owner, shingle = tx.shingles(pa.array(texts), words)
    expected = []
    for k, t in enumerate(texts):
        w = WORDS.findall(lower(t or ""))
        runs = [tuple(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [tuple(w)]
        expected += [(k, r) for r in runs if r]
    assert owner.tolist() == [k for k, _ in expected]
    by = {}
    for h, (_, r) in zip(shingle.tolist(), expected):
        assert by.setdefault(r, h) == h
    assert len(set(by.values())) == len(by)


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": ["abc" * k or None for k in range(9)]})
    for size in (1, 5, 100):
        parts = list(tx.chunks(batch, "text", size))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
