"""Cross-tokenizer alignment against a brute force over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from sluice.llm import alignment

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path(FILES[0]))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=P.path(FILES[1]))


PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BACK = {chr(b): b for b in PLAIN}
BACK |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


def bytes_of_a(name):
    return bytes(BACK[c] for c in name)


def bytes_of_b(piece):
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def spans(ids, sizes):
    at, out = 0, []
    for i, n in zip(ids, sizes):
        out.append((i, at, at + n))
        at += n
    return out


def one(text, a, b):
    """(spans of A, spans of B) of a whole text; nothing if the bytes differ."""
    if not text:
        return [], []
    ia = a.encode(" " + text, add_special_tokens=False).ids
    ib = b.encode(text)
    ba = [bytes_of_a(a.id_to_token(i)) for i in ia]
    bb = [bytes_of_b(b.id_to_piece(i)) for i in ib]
    whole = (" " + text).encode()
    if b"".join(ba) != whole or b"".join(bb) != whole:
        return [], []
    return spans(ia, map(len, ba)), spans(ib, map(len, bb))


def brute(rows, a, b):
    """Result rows of (doc_id, text) rows, pair by pair."""
    docs, count = [], Counter()
    for d, t in rows:
        sa, sb = one(t, a, b)
        links, j = [], 0
        for i, lo, hi in sa:
            while j and sb[j][1] > lo:
                j -= 1
            while j < len(sb) and sb[j][2] <= lo:
                j += 1
            k = j
            while k < len(sb) and sb[k][1] < hi:
                links.append((i, sb[k][0]))
                k += 1
        count.update(links)
        ends = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups, la, lb = [], list(reversed(sa)), list(reversed(sb))
        for e in ends:
            parts = []
            for left in (la, lb):
                parts.append([])
                while left and left[-1][2] <= e:
                    parts[-1].append(str(left.pop()[0]))
            groups.append("|".join(map(",".join, parts)))
        docs.append((d, len(sa), len(sb), groups, links))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted((str(d), na, nb, len(g), len(ls),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if na else "",
                   sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls))
                  for d, na, nb, g, ls in docs)


def result(df):
    return sorted((str(x.doc_id), x.n_a, x.n_b, x.n_groups, x.n_links, x.groups_sha256, x.n_best, x.count_sum)
                  for x in df.collect())


def odd_texts(n, seed=3):
    r = random.Random(seed)
    blocks = [(0x20, 0x7F), (0, 0x20), (0x80, 0x250), (0x300, 0x370), (0x2000, 0x2070), (0x2580, 0x2584),
              (0x3000, 0x3100), (0x4E00, 0x4F00), (0x1F600, 0x1F640), (0, 0x110000)]

    def char():
        while True:
            c = r.randrange(*r.choice(blocks))
            if not 0xD800 <= c < 0xE000:
                return chr(c)
    extra = [" ", "  ", "\n", " \n ", "<|endoftext|>", "<s>", "</s>", "the", "ing", "don't", "1234", " "]
    return ["".join(r.choice([char(), r.choice(extra), r.choice("aeionst ")]) for _ in range(r.randrange(1, 25)))
            for _ in range(n)]


def rows_of_all_kinds():
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b \n", "▁", "x ▁ y", "\U00020000 x",
             "日本語 のテキスト", "é é", "﻿a", "<unk> <s> <|endoftext|>", "a\x00b", "word " * 3000,
             "漢" * 3000, "don't stop", "don't stop"]
    rows = list(enumerate(texts + odd_texts(600))) + [(None, "no id"), (3, "same id")]
    return rows + rows[-5:]


def test_against_brute_force(make, tokenizers):
    rows = rows_of_all_kinds()
    want = brute(rows, *tokenizers)
    got = alignment.align(make(rows, "row string"))
    assert result(got) == want
    # the way beyond the bound of the broadcast
    assert result(alignment.align(make(rows, "links string"), max_broadcast=0)) == want


def test_given_table(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    assert result(alignment.align(docs)) == brute(rows, *tokenizers)


def test_forgetting_and_partial_counts(spark, make, tokenizers, monkeypatch):
    import public_tokenizers as P
    monkeypatch.setattr(alignment, "CACHED", 20)
    al = alignment.Aligner(*[P.path(f) for f in FILES])
    texts = odd_texts(200, 9)
    for t in texts * 2:
        (n_a, n_b, n_g, sha, links), = al.documents([t])
        (_, a, b, g, ls, digest, _, _), = brute([(0, t)], *tokenizers)
        assert (n_a, n_b, n_g, sha, len(links) // 4) == (a, b, g, digest, ls)
    rows = alignment.aligned(make(list(enumerate(texts))))
    key = lambda df: sorted(tuple(x) for x in df.collect())
    assert key(alignment.pair_counts(rows, partial=10)) == key(alignment.pair_counts(rows))


def test_empty_and_stray_bytes(spark, make):
    assert alignment.align(make([])).count() == 0
    df = spark.range(2).selectExpr("id AS doc_id", "if(id = 0, cast(X'61ff62' AS string), 'good text') AS text")
    got = {x.doc_id: x for x in alignment.align(df).collect()}
    assert (got[0].n_a, got[0].n_links, got[0].groups_sha256) == (0, 0, "")
    assert got[1].n_a > 0 and got[1].n_links >= got[1].n_groups
