"""License scans by sentence rules. DataFrame operations only.

A text is normalised to lower-case letters and digits with single blanks.
Wrapped lines are joined, comment leaders dropped; blank lines and ``.``, ``!``
or ``?`` before white space cut it into sentences. A fixed table of licence
sentences is looked up in it: a known sentence counts wherever it stands as
whole words inside one sentence (the longest at a place, none right after
a word that denies it), which gives the document's sequence of sentence
identifiers. Each licence of an ``SPDX-License-Identifier`` expression is a
sentence of its own. Ordered rules are then matched against the sequence: a
rule is a list of identifiers that must occur in that order, with any others
between. Rules are tried from the most specific on; a matched rule consumes
its identifiers, so a rule for a single sentence does not report again what a
longer rule has explained. A rule is tried until it matches no more, so a text
with two copies of a header reports it twice in ``n_matches``; identifiers
that no rule consumes are reported as unmatched. ``n_sentences`` counts lines
and sentences in them: wrapped lines count one each.

The table and the rules are literals of the plan: nothing is joined or
shuffled. Only texts with a word that some known sentence needs are searched.

Defined results: null or empty text has no sentences and no licences;
repeated rows give repeated results; an empty table gives none. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import tokens as tk

CUT = "\x01"      # stands between sentences

# Words right before a known sentence that deny it.
DENIALS = ("not", "never", "no longer", "not currently", "not yet")

# Normalised sentence -> identifier.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-short",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at": "apache2-copy",
    "released under the mit license": "mit-short",
    "this project is licensed under the mit license": "mit-short",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
    "either version 3 of the license or at your option any later version": "gpl3-later",
    "either version 2 of the license or at your option any later version": "gpl2-later",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all rights reserved": "all-rights",
    "licensed under the mit license": "mit-short",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "licensed under the gnu general public license version 3": "gpl3-short",
    "is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
    "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl-grant",
    "is free software you can redistribute it and or modify it under the terms of the gnu library general public license": "lgpl-grant",
    "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license": "agpl-grant",
    "either version 3 or at your option any later version": "gpl3-later",
    "either version 2 or at your option any later version": "gpl2-later",
    "either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-head",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-head",
    "has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-head",
    "has waived all copyright and related or neighboring rights to": "cc0-head",
    "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law": "cc0-head",
    "licensed under cc0 1 0": "cc0-head",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
}
# "version 3" with a later version is not version 3 only
SENTENCES |= {f"{head}licensed under the gnu general public license version {v} {tail}": f"gpl{v}-or-later"
              for head in ("", "this work is ") for v in (2, 3)
              for tail in ("or later", "or any later version", "or at your option any later version")}

# Licences by SPDX identifier; deprecated names to the new ones.
SPDX = {x: x for x in (
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC-BY-NC-4.0", "Unlicense", *(f"{k}-{end}" for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0",
                                                          "AGPL-3.0") for end in ("only", "or-later")))}
SPDX |= {x.removesuffix("-only"): x for x in SPDX if x.endswith("-only")}
SPDX_TAG = "spdx license identifier"
SPDX_LINE = "spdx-license-identifier:"


def spdx_id(licence: str) -> str:
    return f"spdx-{licence.lower()}"


# an identifier counts only as a whole: "MIT-0" is not "MIT"
SENTENCES |= {f"{SPDX_TAG} {x.lower().replace('-', ' ').replace('.', ' ')} {CUT}": spdx_id(name)
              for x, name in SPDX.items()}

# Ordered rules, (licence, identifiers in order).
RULES = [
    ("Apache-2.0", ["apache2-head", "apache2-compliance", "apache2-copy"]),
    ("Apache-2.0", ["apache2-short", "apache2-compliance"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("AGPL-3.0-or-later", ["agpl-grant", "gpl3-later"]),
    ("LGPL-3.0-or-later", ["lgpl-grant", "gpl3-later"]),
    ("LGPL-2.1-or-later", ["lgpl-grant", "lgpl21-later"]),
    ("LGPL-2.0-or-later", ["lgpl-grant", "gpl2-later"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl-grant", "gpl2-later"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant"]),
    ("Apache-2.0", ["apache2-head"]),
    ("Apache-2.0", ["apache2-short"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-grant"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-2.0-or-later", ["gpl-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("Unlicense", ["unlicense-head"]),
    ("GPL-3.0-or-later", ["gpl3-or-later"]),
    ("GPL-2.0-or-later", ["gpl2-or-later"]),
    ("AGPL-3.0-or-later", ["agpl-grant"]),
    ("LGPL-2.0-or-later", ["lgpl-grant"]),
    ("MPL-2.0", ["mpl2-head"]),
    ("ISC", ["isc-grant"]),
    ("CC0-1.0", ["cc0-head"]),
    *((name, [spdx_id(name)]) for name in dict.fromkeys(SPDX.values())),
]


def sentences(text: Column) -> Column:
    """Normalised sentences of a text; empty ones are left out."""
    cut = F.split(F.regexp_replace(text, F.lit(r"([.!?])[\x20\x09-\x0D]+"), F.lit("$1\n")), F.lit("\n"))
    plain = F.transform(cut, lambda s: F.btrim(
        F.regexp_replace(F.lower(s), F.lit("[^0-9a-z]+"), F.lit(" "))))
    return F.filter(plain, lambda s: s != "")


def joined(lower: Column) -> Column:
    """The normalised form, in one line, of a text in lower case; ``CUT``
    between its sentences."""
    sub = lambda x, pattern, to: F.regexp_replace(x, F.lit(pattern), F.lit(to))
    x = sub(lower, CUT, " ")
    x = sub(x, "\r\n?", "\n")
    # no group is repeated without a bound: the JVM matches those by recursion
    x = sub(x, r"(?m)^[^0-9a-z\n]+", "")
    x = sub(x, r"(?m)^(?:rem|dnl)(?=\s)[^0-9a-z\n]*+", "")
    x = F.when(F.contains(lower, F.lit(SPDX_LINE)), spdx_sentences(x)).otherwise(x)
    x = sub(x, r"\bv\.[ \t\n]+(?=[0-9])", "v ")
    x = sub(x, r"[.!?][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n", f" {CUT} ")
    return F.concat(F.lit(" "), F.btrim(sub(x, f"[^0-9a-z{CUT}]+", " ")), F.lit(f" {CUT} "))


def spdx_sentences(text: Column) -> Column:
    """Every licence of an SPDX expression as a tag and its identifier between
    blank lines. An expression ends with its line and is cut at its operators."""
    def licence(operand: Column) -> Column:
        name = F.regexp_extract(operand, "^[ \t(\"']*+([0-9a-z.+-]++)", 1)
        after = F.regexp_replace(operand, F.lit("^[ \t(\"']*+[0-9a-z.+-]++"), F.lit(""))
        plus = F.when(name.endswith("+"), F.concat(F.rtrim(name, F.lit("+")), F.lit("-or-later"))).otherwise(name)
        return F.when(name == "", F.concat(F.lit(f"\n\n{SPDX_LINE} "), operand)).otherwise(
            F.concat(F.lit(f"\n\n{SPDX_LINE} "), plus, F.lit("\n\n"), after))

    def tagged(part: Column, i: Column) -> Column:
        line = F.substring_index(part, "\n", 1)
        operands = F.split(line, r"(?<![ \t()])[ \t()]++(?:and|or|with)[ \t()]++", -1)
        rest = F.substr(part, F.length(line) + 1)
        return F.when(i == 0, part).otherwise(F.concat(F.array_join(F.transform(operands, licence), ""), rest))
    return F.array_join(F.transform(F.split(text, SPDX_LINE, -1), tagged), "")


def table_pattern(known: list[str]) -> str:
    """Pattern of the known sentences, the longest first, by shared beginnings."""
    tree: dict = {}
    for s in known:
        node = tree
        for w in s.split(" "):
            node = node.setdefault(w, {})
        node[""] = {}

    def branch(node: dict) -> str:
        ways = "|".join(f" {w}{branch(n)}" for w, n in node.items() if w)
        return f"(?:{ways})?" if ways and "" in node else f"(?:{ways})" if ways else ""
    return f"{''.join(f'(?<! {w})' for w in DENIALS)}({branch(tree)})(?= |$)"


def needed_words(known: list[str]) -> list[str]:
    """Words of which every known sentence has one, long ones before others."""
    rest, out = [set(s.split(" ")) for s in known], []
    while rest:
        out.append(max(sorted(set().union(*rest)), key=lambda w: (len(w) >= 6, sum(w in s for s in rest), len(w))))
        rest = [s for s in rest if out[-1] not in s]
    return out


def identifiers(lower: Column, table: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text in lower case, in order."""
    none = F.array().cast("array<string>")
    if not table:
        return none
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    any_word = F.lit(False)
    for w in needed_words(list(table)):
        any_word = any_word | F.contains(lower, F.lit(w))
    found = F.regexp_extract_all(joined(lower), F.lit(table_pattern(list(table))), F.lit(1))
    return F.when(any_word, F.transform(found, lambda s: F.element_at(lookup, F.btrim(s, F.lit(" "))))).otherwise(none)


def rule_pattern(ids: list[str]) -> str:
    """Pattern over the sequence ``;a;;b;``: the rule's identifiers in order,
    the shortest gaps; the gaps are kept by number."""
    out = f";{ids[0]};"
    for x in ids[1:]:
        out += f"(.*?);{x};"
    return out


def match_rules(d: DataFrame, rules, rest: str, hit: str) -> DataFrame:
    """``d`` with columns ``hit`` + number: the matches of each rule in ``rest``,
    which keeps what is left over. Rules of one identifier that follow each
    other are one step."""
    k = 0
    while k < len(rules):
        end = k + 1
        while len(rules[k][1]) == 1 and end < len(rules) and len(rules[end][1]) == 1:
            end += 1
        step = list(dict.fromkeys(rule_pattern(ids) for _, ids in rules[k:end]))
        counts = {p: F.regexp_count(rest, F.lit(p)) for p in step}
        gaps = "".join(f"${i + 1}" for i in range(len(rules[k][1]) - 1))
        d = d.select(*[F.col(f"`{c}`") for c in d.columns if c != rest],
                     # a second rule for the same identifier finds nothing left
                     *[counts.pop(rule_pattern(ids), F.lit(0)).alias(f"{hit}{k + i}")
                       for i, (_, ids) in enumerate(rules[k:end])],
                     F.regexp_replace(rest, F.lit("|".join(step)), F.lit(gaps)).alias(rest))
        k = end
    return d


def scan_licenses(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text",
                  table: dict[str, str] | None = None, rules=None) -> DataFrame:
    """Columns ``keep`` (default: all), then n_sentences, sentence_ids,
    licenses (distinct, in rule order), n_matches and unmatched_ids.

    Columns of ``docs`` with one of these names are replaced.
    """
    table, rules = table or SENTENCES, rules or RULES
    new = ["n_sentences", "sentence_ids", "licenses", "n_matches", "unmatched_ids"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    kept = [F.col(f"`{c}`") for c in keep]
    body, low, rest, hits = tk.unused([*keep, *new], "body", "low", "rest", "hits")
    hit = "hit"                 # its columns end with a number
    while any(c.lower().startswith(hit) for c in [*keep, hits]):
        hit += "_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*kept, text.alias(body), F.lower(text).alias(low))
    d = d.select(*kept, F.size(sentences(F.col(body))).cast("bigint").alias("n_sentences"),
                 identifiers(F.col(low), table).alias("sentence_ids"))
    seq = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit(";"), x, F.lit(";"))), "")
    d = match_rules(d.withColumn(rest, seq), rules, rest, hit)
    none = F.lit(0)
    d = d.select(*kept, "n_sentences", "sentence_ids",
                 F.array(*[F.col(f"{hit}{k}") for k in range(len(rules))]).alias(hits), rest)
    names = F.array(*[F.lit(name) for name, _ in rules])
    matched = F.filter(F.zip_with(hits, names, lambda n, x: F.when(n > 0, x)),
                       lambda x: x.isNotNull())
    left = F.filter(F.split(rest, F.lit(";")), lambda x: x != "")
    return d.select(*kept, "n_sentences", "sentence_ids", F.array_distinct(matched).alias("licenses"),
                    F.aggregate(hits, none, lambda a, n: a + F.coalesce(n, none)).cast("bigint")
                    .alias("n_matches"), left.alias("unmatched_ids"))
