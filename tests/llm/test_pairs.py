"""Substring removal, n-gram join, components and decontamination against
brute force, with edge rows and with the parameters that spread work."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import decontam, ngram_join, substring_dedup
from sluice.llm import tokens as tk
from sluice.llm.components import components

EDGE = [(None, "a b c"), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one"),
        (905, "é ü 漢字 " * 30), (906, "x " * 200), (907, "y " * 5000)]


def corpus(seed=7, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(45)]
    line = [r.choice(vocab) for _ in range(8)]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(5, 90))]
        kind = i % 6
        if kind == 1:
            words[3:3] = passage
        elif kind == 2 and rows:
            words = list(rows[r.randrange(len(rows))][1].split())
            if words:
                words[r.randrange(len(words))] = "changed"
        elif kind == 3:
            words = words[:10] + line + words[10:] + line
        elif kind == 4 and rows:
            words = rows[r.randrange(len(rows))][1].split()
        rows.append((i, ("\n" if i % 5 == 0 else " ").join(words)))
    return rows


def brute_removed(rows):
    seen, out = {}, {}
    order = sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t in order:
        w = (t or "").encode().split()
        for i in range(len(w) - 19):
            seen.setdefault(tuple(w[i:i + 20]), (d, i))
    for d, t in order:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - 19):
            if seen[tuple(w[i:i + 20])] != (d, i):
                gone.update(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_match_brute_force(make):
    rows = corpus() + EDGE
    want = brute_removed(rows)
    for limits in ({}, {"hot": 3, "hot_local": 1, "shard_words": 100}):
        out = substring_dedup.dedup_substrings(make(rows), carry=["lang"], **limits).collect()
        assert {r.doc: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == want
        for r in out:
            text = dict(rows)[r.doc]
            if text is None:
                assert r.kept_text is None
                continue
            if not r.n_removed:
                assert r.kept_text == text
            assert hashlib.sha256(b" ".join(r.kept_text.encode().split())).hexdigest() == r.kept_sha256
            assert r.row.lang == "en"


def test_substrings_of_repeated_rows_and_empty_table(make):
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t u v")] * 2
    assert {r.n_removed for r in substring_dedup.dedup_substrings(make(rows)).collect()} == {0}
    assert substring_dedup.dedup_substrings(make([])).count() == 0
    kept = substring_dedup.without_repeats(make(rows + [(2, rows[0][1]), (3, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 3]
    assert kept.columns == make([]).columns


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        s = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[d] = s
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}
    links = dict.fromkeys(sets, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d) if d is not None else None, links[d]) for d in sets}


def chain(n=40):
    """Neighbours differ by few words: links form one long path."""
    base = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(n):
        base[(i * 7) % 60] = f"n{i}"
        rows.append((1000 + (i * 17) % n, " ".join(base)))
    return rows


def test_components_match_brute_force(make):
    rows = corpus(3) + chain() + EDGE
    want = brute_components(rows)
    assert len({w[1] for w in want.values()}) < len(want) - 20
    for knobs in ({}, {"common": 2, "common_local": 1, "split": 3, "block_docs": 2}):
        out = ngram_join.link_components(make(rows), **knobs).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in out} == want


def test_many_near_copies_are_one_component(make):
    r = random.Random(1)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        w[r.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows)
    out = ngram_join.link_components(make(rows), common=2, common_local=1, split=10, block_tokens=3000).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in out} == want


def test_join_of_empty_and_repeated_rows(make):
    assert ngram_join.link_components(make([])).count() == 0
    out = ngram_join.link_components(make([(5, "a b c d e f"), (5, "a b c d e f"), (6, "A b c d e F")]))
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(5, 5), (5, 5), (6, 5)]


def test_component_contraction(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 199)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 150: 150, 199: 150, 200: 150}


def test_decontamination(make, spark):
    items = [("b1", "One two three four five six seven eight nine ten eleven."), ("b2", "short item"),
             ("b3", ""), ("b4", None), (None, "nobody knows this"), ("b1", "short item")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    hit = "one two, three four five six seven eight nine ten and"
    rows = [(1, "zero " + hit), (2, "a short-item b"), (3, "one two three"), (4, None), (5, ""),
            (6, "x nobody KNOWS this x short item"), (7, "clean " * 3000)]
    for block in (decontam.BLOCK_BYTES, 60, 20):        # one block, a few, more than CHAIN
        out = {r.doc_id: r for r in decontam.scan(make(rows), bench, block_bytes=block).collect()}
        assert (out[1].hit_words, out[1].hit_items) == (10, ["b1"])
        assert [tuple(s) for s in out[1].hit_spans] == [(1, 10)]
        assert (out[2].hit_words, out[2].hit_items) == (2, ["b1", "b2"])
        assert (out[6].hit_words, out[6].hit_items) == (5, ["", "b1", "b2"])
        assert [out[i].hit_words for i in (3, 4, 5, 7)] == [0, 0, 0, 0] and out[7].n_words == 3000
        kept = decontam.clean_documents(make(rows), bench, block_bytes=block)
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7]
        assert kept.columns == make([]).columns
    assert decontam.scan(make([]), bench).count() == 0
    none = decontam.scan(make(rows), bench.limit(0))
    assert none.agg(F.sum("hit_words")).first()[0] == 0


def brute_hits(text, items, n=10):
    norm = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(
        {c: c + 32 for c in range(65, 91)}))
    w = norm(text)
    hit, who = set(), set()
    for item, t in items:
        b = norm(t)
        k = min(n, len(b))
        for i in range(len(b) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j:j + k] == b[i:i + k]:
                    hit.update(range(j, j + k))
                    who.add(item)
    return hit, who


@pytest.mark.parametrize("coarse", [64, 6, 1])
def test_hits_match_brute_force_with_equal_hashes(monkeypatch, coarse):
    whole = tk.grams
    monkeypatch.setattr(tk, "grams", lambda h, m: whole(h, m) & np.uint64(((1 << coarse) - 1) << (64 - coarse)))
    r = random.Random(coarse)
    text = lambda n: " ".join(r.choice(["Ab", "ab", "c", "d\u00e9", "e-f", "9", "."]) for _ in range(n))
    items = [(f"i{k}", text(r.choice([0, 2, 4, 7, 12]))) for k in range(12)] + [("i3", "c c 9"), ("i5", "c c 9")]
    docs = [text(r.randint(0, 60)) for _ in range(40)] + ["", "c c 9", items[0][1]]
    tests = decontam.TestGrams(items, 4)
    maps = {k: g.bitmap() for k, g in tests.grams.items()}
    seen = 0
    for s in tk.slices(pa.array(docs), tk.NON_ALNUM, tk.LOWER):
        mask, found = decontam.find_hits(s, tests, maps)
        for d in range(s.n_docs):
            hit, who = brute_hits(docs[s.first + d], items, 4)
            assert set(np.flatnonzero(mask[s.word_off[d]:s.word_off[d + 1]]).tolist()) == hit
            assert {tests.items[i] for i in found.get(d, ())} == who
            seen += bool(hit)
    assert seen > 5


def test_a_block_is_small_in_memory():
    r = random.Random(1)
    rows = [(str(i), " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(100)))
            for i in range(500)]
    tests = decontam.TestGrams(rows, 10)
    held = len(tests.words) + sum(x.nbytes for g in tests.grams.values()
                                  for x in (g.hashes, g.lo, g.hi, g.first, g.owner, g.bitmap()))
    assert held < 12 * sum(len(t) for _, t in rows)
