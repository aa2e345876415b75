"""Word positions and hashes against Python's split."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import tokens as tk
from sluice.llm.fm_index import FMIndex

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\rÉé漢9.", max_size=30)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_words_match_split(texts, limit):
    got = []
    for s in tk.slices(pa.array(texts, pa.string()), limit=limit):
        for d in range(s.n_docs):
            got.append(s.words_of(s.word_off[d], s.word_off[d + 1]))
    assert got == [(t or "").encode().split() for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_alnum_words(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low)) for t in texts]
    got = []
    for s in tk.slices(pa.array(texts, pa.string()), tk.NON_ALNUM, tk.LOWER):
        for d in range(s.n_docs):
            got.append([w.decode() for w in s.words_of(s.word_off[d], s.word_off[d + 1])])
    assert got == want


def test_equal_words_equal_hashes_across_pieces():
    long = "w" * 3_000_000
    s = next(tk.slices(pa.array([f"abc {long} abc x"])))
    h = s.hashes()
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    assert s.hashes(2)[0] == tk.word_hash(["ab"])[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=6, max_size=60), st.integers(2, 6))
def test_backward_search_is_exact(symbols, length):
    text = np.array(symbols + [0])
    index = FMIndex(text, 4)
    at = np.arange(len(symbols) - length + 1)
    if not len(at):
        return
    live, lo, hi = index.matching(at, length)
    first = dict(zip(live.tolist(), index.earliest(lo, hi).tolist()))
    for i in at.tolist():
        places = [j for j in at.tolist() if symbols[j:j + length] == symbols[i:i + length]]
        assert first.get(i) == (places[0] if len(places) > 1 else None)
