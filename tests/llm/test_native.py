"""Licence scans, mixing, chat formatting and quality rules: hand-worked rows,
edge rows, round trips; no Python in their plans."""

import hashlib
import io
import random
import re
import textwrap
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from sluice.llm import chat, licenses, mixing, quality_rules

EDGE = [(None, "a b"), (900, None), (901, ""), (902, " \t\n"), (903, "word " * 4000), (903, "word " * 4000)]


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return " ".join(re.findall(r"\w*(?:MapIn|EvalPython|InPandas|InArrow|PythonUDF)\w*", out.getvalue()))


def test_license_rules(make):
    rows = [(1, "Intro text. Licensed under the Apache License, Version 2.0."),
            (2, "Permission is hereby granted, free of charge, to any person obtaining a copy\nbla bla\n"
                "The above copyright notice and this permission notice shall be included in all copies or "
                "substantial portions of the Software."),
            (3, "Released under the MIT License! All rights reserved. Released under the MIT license"),
            (4, "Redistribution and use in source and binary forms, with or without modification, are "
                "permitted provided that the following conditions are met:"),
            (5, "You may not use this file except in compliance with the License.\n"
                "Licensed under the Apache License, Version 2.0")] + EDGE
    got = {r.doc_id: r for r in licenses.scan_licenses(make(rows, "licenses string")).collect()}
    assert got[1].licenses == ["Apache-2.0"] and got[1].n_sentences == 2 and got[1].n_matches == 1
    assert got[2].licenses == ["MIT"] and got[2].sentence_ids == ["mit-grant", "mit-notice"]
    assert got[2].n_matches == 1                      # the longer rule explains both sentences
    assert got[3].licenses == ["MIT"] and got[3].n_matches == 2
    assert got[3].unmatched_ids == ["all-rights"]
    assert got[4].licenses == ["BSD-2-Clause"]
    # identifiers in the wrong order do not make the header rule
    assert got[5].licenses == ["Apache-2.0"] and got[5].unmatched_ids == ["apache2-compliance"]
    assert all(got[i].licenses == [] and got[i].n_matches == 0 for i in (900, 901, 902, 903))
    assert licenses.scan_licenses(make([], "licenses string")).count() == 0
    assert not plan_of(licenses.scan_licenses(make(rows)))


GPL = ("This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General "
       "Public License as published by the Free Software Foundation{} either version {} of the License, or (at your "
       "option) any later version.")
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
       "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice.")
CANONICAL = [
    ("GPL-3.0-or-later", GPL.format(":", "", ",", 3)),
    ("GPL-2.0-or-later", GPL.format(";", "", ";", 2)),
    ("LGPL-3.0-or-later", GPL.format(":", "Lesser ", ",", 3)),
    ("LGPL-2.1-or-later", GPL.format(";", "Lesser ", ";", 2.1).replace("program", "library")),
    ("AGPL-3.0-or-later", GPL.format(":", "Affero ", ",", 3).replace("This program", "Frob")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files. The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    ("MIT", "This file is released under the MIT License."),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be "
                           "used to endorse or promote products derived from this software without specific prior "
                           "written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
                "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and "
                "neighboring rights to this software to the public domain worldwide."),
    ("GPL-3.0-or-later", "This work is licensed under the GNU General Public License, version 3 or (at your option) "
                         "any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def test_canonical_license_texts_in_any_layout(make):
    rows = []
    for i, (_, text) in enumerate(CANONICAL):
        lines = textwrap.wrap(text, 34)
        layouts = [text, "\n".join(lines), "\r\n".join(lines), "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */",
                   *("\n".join(f"{c} {x}" for x in lines) for c in ("#", "//", "!", "--", "REM", "dnl", ";;"))]
        rows += [(100 * i + k, f"Title\n\n{x}\n\nint x") for k, x in enumerate(layouts)]
    got = licenses.scan_licenses(make(rows)).collect()
    assert len(got) == len(rows) == 11 * len(CANONICAL)
    for r in got:
        assert r.licenses == [CANONICAL[r.doc_id // 100][0]] and r.n_matches == 1 and r.unmatched_ids == [], r


def test_license_sentences_have_borders(make):
    rows = [(1, "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+\nonly x"),
            (2, "// SPDX-License-Identifier: MIT-0"),
            (3, "/* SPDX-License-Identifier: LGPL-2.1-only WITH GCC-exception-3.1 */ int x"),
            (4, "It is not released under\nthe MIT License."),
            (5, "Released under the MIT\n\nLicense"),            # a blank line ends a sentence
            (6, "It is licensed. Under the MIT License, nothing is."),
            (7, "unlicensed under the MIT License"),
            (8, "Licensed under the Apache License, Version 2.0. The License is long."),
            (9, "a\x01b Released under the MIT License" + " word" * 4000)]
    got = {r.doc_id: r for r in licenses.scan_licenses(make(rows)).collect()}
    assert got[1].sentence_ids == ["spdx-mit", "spdx-apache-2.0", "spdx-gpl-2.0-or-later"]
    assert sorted(got[1].licenses) == ["Apache-2.0", "GPL-2.0-or-later", "MIT"] and got[1].n_matches == 3
    assert got[3].licenses == ["LGPL-2.1-only"]
    assert all(got[i].sentence_ids == [] for i in (2, 4, 5, 6, 7))
    assert got[8].sentence_ids == ["apache2-short"] and got[9].licenses == ["MIT"]


def brute_targets(sizes):
    """Deal 150 % by weight; what exceeds twice a source is dealt again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        add = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s, x in add.items():
            target[s] += x
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix_targets_and_budgets(make):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), "en", r.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot"]))
            for i in range(600)] + [(5000, "", "en", "empty"), (None, "x y", "en", "b"), (5001, None, "en", "b"),
                                    (7, "again " * 9, "en", "a")]
    got = mixing.mix(make(rows, "taken string")).collect()
    assert len(got) == len(rows)
    size, taken, biggest = {}, {}, {}
    for x in got:
        assert x.taken == x.copies * x.size and 0 <= x.copies <= 2
        size[x.source] = size.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        biggest[x.source] = max(biggest.get(x.source, 0), x.size)
    want = brute_targets(size)
    for x in got:
        assert x.source_size == size[x.source] and abs(x.target - want[x.source]) < 1e-6
    for s in size:
        assert abs(taken[s] - want[s]) <= biggest[s]
    again = mixing.mix(make(list(reversed(rows)), "taken string")).collect()
    key = lambda x: (x.id or -1, x.source or "", x.size, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(make([])).count() == 0
    kept = mixing.mixed_documents(make(rows, "taken string"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size",
                            "target", "copies", "taken"]
    assert kept.agg(F.sum("taken")).first()[0] == sum(taken.values())
    assert not plan_of(kept)


def test_chat_round_trip(spark):
    r = random.Random(2)
    alphabet = ["<|im_end|>", "<|im_start|>", "&", "&amp;", "&lt;|", "<", "|", "\n", "é", "漢", "&nl;", " x", "<|"]
    rows = []
    for c in list(range(20)) + [None]:
        for t in range(r.randint(1, 6)):
            text = None if r.random() < .1 else "".join(r.choice(alphabet) for _ in range(r.randint(0, 9)))
            rows.append((c, t, r.choice(["user", "assistant", "system", None, "a<|b\nc&"]), text, "x"))
    rows.append((3, 0, "assistant", "tie", "x"))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    out = chat.read_back(chat.format_chats(turns.repartition(3)))
    assert not plan_of(out)
    esc = lambda s: s.replace("&", "&amp;").replace("<|", "&lt;|")
    for x in out.collect():
        want = sorted(((t, ro or "", esc(te or ""), te or "") for c, t, ro, te, _ in rows if c == x.conv))
        assert [(y.role, y.text) for y in x.turns] == [(w[1], w[3]) for w in want]
        assert list(x.loss_texts) == [w[3] for w in want if w[1] == "assistant" and w[3]]
        assert x.formatted.count("<|im_start|>") == x.formatted.count("<|im_end|>") == len(want) == x.n_turns
        for s, w in zip(x.loss_spans, want):
            under = x.formatted[s.start:s.start + s.length]
            assert under == (w[2] if w[1] == "assistant" else "")
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = f"array<{chat.PART}>"
    rows = [(1, 0, "user", [("text", "see ", None, None, None, None, None),
                            ("image", None, "i.png", 57, 28, None, None),
                            ("text", " and <|x", None, None, None, None, None),
                            ("audio", None, "a.wav", None, None, 2.0, None),
                            ("document", None, "d.pdf", None, None, None, 3)]),
            (1, 1, "assistant", [("text", "ok", None, None, None, None, None)]),
            (2, 0, "user", None), (2, 1, "user", [(None, "t", "r", None, None, None, None)])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, c {parts}")
    out = {x.conv: x for x in chat.format_chats(turns, parts=F.col("c")).collect()}
    assert out[1].formatted == ("<|im_start|>user\nsee <|image_0|> and &lt;|x<|audio_1|><|document_2|><|im_end|>\n"
                                "<|im_start|>assistant\nok<|im_end|>\n")
    assert [(a.turn_no, a.place, a.kind, a.ref, a.tokens) for a in out[1].attachments] == [
        (1, 0, "image", "i.png", 3), (1, 1, "audio", "a.wav", 50), (1, 2, "document", "d.pdf", 1536)]
    assert out[1].expanded_tokens == 1589
    assert out[2].formatted.endswith("<|im_start|>user\n<|unknown_0|><|im_end|>\n") and out[2].expanded_tokens == 0


def brute_base(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            hit.update(range(i, i + 8))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_quality_base_counts(make):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(["a", "b ", "c\n", "é ", "#", "|", "d d d d d d d d d\n", "\t", "ü\x0b"])
                        for _ in range(r.randint(0, 80)))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, "\n\n \t"), (903, "w " * 300), (904, "p q r s t u v w x " * 3),
             (904, "p q r s t u v w x " * 3)]
    got = quality_rules.quality(make(rows, "kept string"), keep=["doc_id"]).collect()
    want = dict(rows)
    for x in got:
        n, chars, symbols, dup, rep = brute_base(want[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert x.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (x.base_failed and x.kept)
    assert quality_rules.quality(make([]), keep=["doc_id"]).count() == 0


def test_quality_divergence(make):
    r = random.Random(4)
    common = quality_rules.COMMON["en"]
    plain = lambda: " ".join(r.choice(common) if r.random() < .4 else f"{r.choice('abcdef')}{r.choice('ghij')}lk"
                             for _ in range(150)) + "."
    rows = [(i, plain()) for i in range(40)]
    rows += [(100, plain().upper()), (101, " ".join(f"{w}###" for w in plain().split())),
             (102, plain(), None), (103, plain(), "xx"), (104, "#### short 12345")]
    got = {x.doc_id: x for x in quality_rules.quality(make(rows)).collect()}
    assert all(got[i].kept for i in list(range(40)) + [102, 103])
    assert not got[100].kept and not got[101].kept and not got[104].kept
    assert got[104].char_distance is None             # guarded by length
    assert got[103].word_distance is None             # no common words known


def made_up_language(r, n, own):
    """Texts of a language without listed words: a fifth of the words are its own."""
    return " ".join(r.choice(own) if r.random() < .4 else "".join(r.choice("abcdefgh") for _ in range(6))
                    for _ in range(n)) + "."


def test_quality_of_unlisted_languages(make):
    r = random.Random(8)
    own = [f"z{c}{d}" for c in "abcde" for d in "op"]
    rows = [(i, made_up_language(r, 120, own), "xx") for i in range(40)]
    rows += [(50 + i, made_up_language(r, 120, ["only", "few"]), "yy") for i in range(5)]
    rows += [(90, made_up_language(r, 120, ["qqq"]), "xx"), (91, made_up_language(r, 120, own), None),
             (92, "1 2 3 4 " * 3 + " ".join(map(str, range(60))), "xx")]
    docs = make(rows)
    words = quality_rules.learned_words(docs, "text", "lang").collect()
    assert [x.lang for x in words] == ["xx"]                    # yy has too few documents
    assert len(words[0].words) == quality_rules.N_WORD_BINS and set(own) < set(words[0].words)
    got = {x.doc_id: x for x in quality_rules.quality(docs).collect()}
    assert all(got[i].kept and got[i].word_distance is not None for i in range(40))
    assert got[91].kept and got[91].word_distance is None and got[50].word_distance is None
    assert not got[90].kept and got[90].word_distance > .42     # its common words are not the language's
    assert not got[92].kept and got[92].word_distance > .42     # no letter at all


def test_quality_agrees_with_sql_on_odd_rows(make):
    import duckdb

    from sluice.llm.oracle import ORACLE
    r = random.Random(9)
    own = [f"z{c}{d}" for c in "abcde" for d in "op"]
    langs = ["en", "xx", None, "yy", "de"]
    rows = [(i, made_up_language(r, r.choice([10, 30, 39, 40, 45, 90, 200]),
                                 own if langs[i % 5] != "en" else quality_rules.COMMON["en"]),
             langs[i % 5]) for i in range(150)]
    rows += [(200, "1 2 | " * 40, "xx"), (201, None, "xx"), (202, "", None), (203, "| # " * 300, "zz")]
    docs = make(rows)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    cols = ["doc_id", "n_words", "n_repeat_words", "kept", "char_distance", "word_distance"]
    want = {x[0]: x[1:] for x in con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE['op9_quality_rules']})").fetchall()}
    got = {x[0]: tuple(x[1:]) for x in quality_rules.quality(docs, keep=["doc_id"]).select(cols).collect()}
    assert got.keys() == want.keys()
    for i, (n, rep, kept, char, word) in got.items():
        assert (n, rep, kept) == want[i][:3], i
        for a, b in ((char, want[i][3]), (word, want[i][4])):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 2e-6), i


def test_quality_passes_clashing_columns_on(make):
    docs = make([(1, "a b c " * 20), (2, "x")], "row string").withColumnsRenamed({"source": "__text", "n_chars": "tokens"})
    got = quality_rules.quality(docs)
    assert got.columns[:6] == docs.columns
    assert {x["__text"] for x in got.collect()} == {"src0"} and {x.row for x in got.collect()} == {"x"}
    assert quality_rules.quality(docs, keep=[]).columns[0] == "n_words"


def test_js_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [0.5, 0.5])],
                               "p array<double>, q array<double>")
    d = [x[0] for x in df.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect()]
    assert d[0] == 0 and abs(d[1] - 1) < 1e-12 and abs(d[2] - 0.3112781 ** .5) < 1e-6


def test_digest_probe(spark):
    probe = "<|im_end|><|im_start|>assistant ok"
    turns = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)],
                                  "conv_id long, turn long, role string, text string")
    x = chat.digest(chat.format_chats(turns)).collect()[0]
    assert x.n_turns == 2 and x.loss_chars == len(probe)
    assert x.loss_sha256 == hashlib.sha256(probe.encode()).hexdigest()
    assert x.turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
