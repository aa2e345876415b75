"""Packing: ids against the whole tokenizer, pieces against the contract."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import packing as pk
from sluice.llm.word_bpe import WordBpe

FILE = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(FILE)
BPE = WordBpe(FILE)


@pytest.fixture
def tokenizer():
    return TOKENIZER


PARTS = ["The", "quick", "don't", "IT'S", "'s", "we'll'd", "x1y22", "²³½", "<|endoftext|>", "<|", "|>",
         "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "ÀÉÎ", "straße", "İstanbul", "ŉ", "ſ", "µm",
         "é", "́", "日本語", "ΟΔΟΣ", "Σ", "ﬁ", "Å", "😀👍🏽", "‍", "﻿", "­", "\u0085",
         " ", " ", "　", "\x1c", "\x1f", "\x00", "�", "\t", "\n", "\r\n", "\x0b", "\x0c", "...",
         "!!??", "--", "_a_", "#*$%", "a" * 90, "9" * 40, "Ж", "мир", "नमस्ते", "א", "ª", "º", "¼", "¾", "đ"]


@pytest.mark.parametrize("seed", range(6))
def test_ids_of_odd_texts(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(PARTS) + r.choice(["", " ", "  ", "\n", ""]) for _ in range(r.randint(0, 40)))
             for _ in range(400)]
    same(TOKENIZER, BPE, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=8))
def test_ids_of_any_text(texts):
    same(TOKENIZER, BPE, texts)


def same(tokenizer, bpe, texts):
    ids, counts = bpe.encode(texts)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    at = 0
    for text, w in zip(texts, want):
        assert ids[at:at + len(w)].tolist() == w, repr(text)
        at += len(w)


def test_words_are_forgotten(tokenizer, monkeypatch):
    from sluice.llm import word_bpe
    monkeypatch.setattr(word_bpe, "CACHED_WORDS", 5)
    b = WordBpe(FILE)
    for i in range(6):
        same(tokenizer, b, [f"word{i} of many others {i}", "b" * 200, "", "b" * 200])


def prose(r, n):
    return " ".join(r.choice(["river", "mountain", "of", "the", "quiet", "stone", "2024", "don't"]) for _ in range(n))


def corpus():
    r = random.Random(11)
    rows = [(i, prose(r, r.choice([3, 40, 200, 700]))) for i in range(160)]
    rows += [(1000 + i, prose(r, 6)) for i in range(200)]                   # a third of all in one class
    rows += [(2000, None), (2001, ""), (2002, prose(r, 9000)), (2003, "<|endoftext|> a"),
             (2004, "日本語 😀"), (2005, " \n "), (2006, prose(r, 4095))]
    rows += [(5, rows[5][1]), (None, "no id")]                              # repeated row, no id
    return rows


def contract(rows, got, tokenizer, window):
    """Every id in exactly one piece, sequences gapless, little padding."""
    want = {}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append(ids)
    pieces = {}
    for g in got:
        pieces.setdefault(g.doc_id, []).append(g)
    assert pieces.keys() == want.keys()
    for i, docs in want.items():
        ids = docs[0]                                   # rows that share an id share their text
        cover = Counter()
        for g in pieces[i]:
            assert g.doc_tokens == len(ids) and g.length > 0
            part = ids[g.start:g.start + g.length]
            assert len(part) == g.length
            assert g.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            cover.update(range(g.start, g.start + g.length))
        assert cover == Counter({k: len(docs) for k in range(len(ids))})
    seqs = {}
    for g in got:
        seqs.setdefault(g.sequence_id, []).append((g.offset, g.length))
    sizes = []
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
        sizes.append(at)
    total = sum(len(d) for docs in want.values() for d in docs)
    assert sum(sizes) == total
    assert len(seqs) == -(-total // window)             # only the last one is short


@pytest.mark.parametrize("window, unit", [(4096, 16), (256, 16), (64, 4)])
def test_pieces(make, tokenizer, window, unit):
    rows = corpus()
    got = pk.checksums(pk.pack(make(rows), window=window, unit=unit)).collect()
    contract(rows, got, tokenizer, window)


def test_given_table(spark, tokenizer):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    contract(rows, pk.checksums(pk.pack(df)).collect(), tokenizer, pk.WINDOW)


def test_empty_table_and_single_rows(make, tokenizer):
    empty = pk.checksums(pk.pack(make([])))
    assert empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert empty.count() == 0
    for rows in ([(1, None)], [(1, "a"), (2, "a")]):
        contract(rows, pk.checksums(pk.pack(make(rows))).collect(), tokenizer, pk.WINDOW)


def test_sequences_hold_the_ids(make, tokenizer):
    rows = [(i, prose(random.Random(i), 30 + i)) for i in range(40)]
    ids = sorted(x for _, t in rows for x in tokenizer.encode(t, add_special_tokens=False).ids + [2])
    seqs = pk.sequences(pk.pack(make(rows), window=256)).collect()
    assert sorted(x for s in seqs for x in s.ids) == ids
    assert all(len(s.ids) <= 256 and s.pieces[0] == 0 and s.pieces == sorted(s.pieces) for s in seqs)


def test_least_squares_meets_the_optimum_conditions():
    r = np.random.default_rng(2)
    combos = [c for c in pk.combinations(24)]
    deep = max(len(p) for p, _ in combos)
    places = np.array([p + (25,) * (deep - len(p)) for p, _ in combos])
    weights = np.array([[float(t)] * deep for _, t in combos])
    a = np.column_stack([np.bincount(p, w, 26)[:25] for p, w in zip(places, weights)])
    for _ in range(4):
        goal = np.append(0.0, r.random(24))
        x = pk.nnls(places, weights, goal)
        slope = a.T @ (goal - a @ x)
        assert (x >= 0).all() and slope.max() <= 1e-6 and np.abs(slope[x > 0]).max() <= 1e-6


def test_combinations_fill_the_window():
    combos = pk.combinations(32)
    assert len(set(combos)) == len(combos)
    assert all(sum(p) * times == 32 and list(p) == sorted(p) and min(p) > 0 for p, times in combos)
    brute = {(a, b, 32 - a - b) for a in range(1, 33) for b in range(a, 33) if 32 - a - b >= b}
    assert brute == {p for p, times in combos if times == 1 and len(p) == 3}


def test_plan_takes_no_more_than_there_is():
    r = np.random.default_rng(4)
    for _ in range(5):
        histogram = r.integers(0, 400, 33)
        plan = pk.solve(histogram)
        used = Counter()
        for pieces, n in plan:
            assert n > 0 and sum(g * m for g, m in pieces.items()) == 32
            used.update({g: m * n for g, m in pieces.items()})
        assert all(used[g] <= histogram[g] for g in used) and 0 not in used
        assert used.total() > 0.8 * histogram[1:].sum()             # most pieces are placed


def test_widened_ids_are_a_slice_at_a_time():
    import pyarrow as pa
    r = np.random.default_rng(3)
    n = r.integers(1, 50, 300)
    ids = [r.integers(0, 60000, k) for k in n]
    want = [x.astype("<u4").tobytes() for x in ids]
    for kind in ("<u2", "<u4"):
        col = pa.array([b"x", *[x.astype(kind).tobytes() for x in ids]], pa.binary()).slice(1)
        assert pk.wide_ids(col, n).to_pylist() == want
    assert pk.wide_ids(pa.array([], pa.binary()), n[:0]).to_pylist() == []
    assert pk.WIDEN_ROWS * 4 * pk.WINDOW <= 8 << 20
