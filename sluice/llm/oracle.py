"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE["op10_decontaminate"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
lens AS (SELECT DISTINCT k FROM grams),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hits AS (SELECT doc_id, k, i, item_id FROM dw JOIN grams USING (k, g)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Budgets end on a hash: running sums over all documents in hash order give
# the same cut as the refined histograms.
ORACLE["op4_mix_sources"] = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({SPACE_WORDS}) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] AS w, 2.0::DOUBLE * source_size AS stop FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(stop) OVER (
             ORDER BY stop / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY stop / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2),
f AS (SELECT min_by(lvl, stop / w) AS lvl FROM s3 WHERE stop / w > lvl),
t AS (SELECT source, source_size, CASE WHEN f.lvl IS NULL OR stop / w <= f.lvl THEN stop ELSE w * f.lvl END AS target
      FROM s3 LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
g AS (SELECT d.source, h, sum(size) AS n FROM d GROUP BY ALL),
c AS (SELECT g.source, h, n, p.target - p.copies * p.source_size AS budget,
             sum(n) OVER (PARTITION BY g.source ORDER BY h) AS upto
      FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, min(h) AS h FROM c WHERE upto > budget AND budget > 0 GROUP BY source),
cut AS (SELECT c.source, CASE WHEN c.upto - c.budget < c.budget - (c.upto - c.n) THEN c.h ELSE c.h - 1 END AS cutoff
        FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source AND c.h = e.h)
SELECT d.doc_id, d.size, p.source_size, round(p.target, 6) AS target,
       CAST((p.copies + CASE WHEN d.h <= coalesce(cut.cutoff, -1) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""

ORACLE["op7_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS et,
         replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;') AS er FROM c),
a AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, et) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, et) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(length('<|im_start|>' || er || chr(10) || et || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars, CAST(0 AS BIGINT) AS n_attachments,
       CAST(0 AS BIGINT) AS expanded_tokens
FROM a
"""

_CLASSES = [r"\p{Lu}", r"\p{Ll}", "0-9", r"\x20\x09-\x0D", r".,;:!?''\"()\-", "#*$%&|<>"]
_COMMON = {
    "de": "das den der des die ein ist mit und von zu",
    "en": "a and for in is it of on that the to",
    "es": "de del el en la las los para por que y",
    "fr": "de des du en et la le les que un une",
}
_LISTED = ", ".join(f"'{k}'" for k in _COMMON)
_SHARES = "list_transform({0}, lambda x: x::DOUBLE / {1})"
_PLOGP = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p[i] + q[i]) / 2)) ELSE 0 END"


def _distance(name: str, p: str, q: str) -> str:
    return f"""(SELECT sqrt(greatest(sum({_PLOGP.format('p[i]')} + {_PLOGP.format('q[i]')}) / 2, 0))
      FROM (SELECT {p} AS p, {q} AS q, unnest(range(1, len({p}) + 1)) AS i))"""


def _pool(name: str, rows: str) -> str:
    """References: class and word sums by language, as shares."""
    return f"""
{name}c AS (SELECT lang, i, sum(v)::DOUBLE AS v FROM (
    SELECT lang, unnest(range(1, len(classes) + 1)) AS i, unnest(classes) AS v FROM {rows}) GROUP BY lang, i),
{name}w AS (SELECT lang, i, sum(v)::DOUBLE AS v FROM (
    SELECT lang, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS v FROM {rows}) GROUP BY lang, i),
{name} AS (
  SELECT c.lang, rc, rw
  FROM (SELECT lang, list(v / t ORDER BY i) AS rc FROM (SELECT *, sum(v) OVER (PARTITION BY lang) AS t FROM {name}c) GROUP BY lang) c
  JOIN (SELECT lang, list(v / t ORDER BY i) AS rw FROM (SELECT *, sum(v) OVER (PARTITION BY lang) AS t FROM {name}w) GROUP BY lang) w
    ON c.lang IS NOT DISTINCT FROM w.lang)"""


def _judge(name: str, refs: str) -> str:
    return f"""
{name}0 AS (
  SELECT h.*, CASE WHEN chars >= 200 AND rc IS NOT NULL
                   THEN {_distance('c', "list_transform(classes, lambda x: x::DOUBLE / chars)", "rc")} END AS char_distance,
         CASE WHEN n_words >= 40 AND len(rw) > 1
              THEN {_distance('w', "list_transform(words, lambda x: x::DOUBLE / greatest(n_tokens, 1))", "rw")} END AS word_distance
  FROM h LEFT JOIN {refs} r ON h.lang IS NOT DISTINCT FROM r.lang),
{name} AS (
  SELECT *, coalesce(char_distance > 0.3, false) OR coalesce(word_distance > 0.42, false)
            OR coalesce((char_distance + word_distance) / 2 > 0.22, false) AS far FROM {name}0)"""


ORACLE["op9_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {SPACE_WORDS} AS w FROM documents),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_rep FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(text) AS BIGINT) AS chars,
         [{', '.join(f"CAST(length(regexp_replace(text, '[^{c}]+', '', 'g')) AS BIGINT)" for c in _CLASSES)}] AS cls,
         list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g'), ' '), lambda t: t <> '') AS tokens
  FROM d LEFT JOIN l ON d.doc_id IS NOT DISTINCT FROM l.doc_id LEFT JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id),
many AS (SELECT lang FROM f WHERE lang NOT IN ({_LISTED}) GROUP BY lang HAVING count(*) >= 20),
held AS (SELECT lang, t, count(*) AS n FROM (SELECT lang, unnest(list_distinct(tokens)) AS t FROM f JOIN many USING (lang)) GROUP BY lang, t),
known AS (SELECT lang, list(t ORDER BY t) AS known FROM (
    SELECT lang, t, row_number() OVER (PARTITION BY lang ORDER BY n DESC, t) AS k FROM held) WHERE k <= 11 GROUP BY lang),
h0 AS (
  SELECT *, len(tokens) AS n_tokens, list_append(cls, CAST(chars - list_sum(cls) AS BIGINT)) AS classes,
         CASE {' '.join(f"WHEN lang = '{k}' THEN [{', '.join(f'''len(list_filter(tokens, lambda t: t = '{x}'))''' for x in v.split())}]" for k, v in _COMMON.items())}
              ELSE coalesce(list_transform(known, lambda k: len(list_filter(tokens, lambda t: t = k))), []) END AS bins,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM f LEFT JOIN known USING (lang)),
h AS (SELECT *, list_append(bins, CAST(n_tokens - coalesce(list_sum(bins), 0) AS BIGINT)) AS words FROM h0),
{_pool('ref1', "(SELECT * FROM h WHERE NOT base_failed)")},
{_judge('j1', 'ref1')},
{_pool('ref2', "(SELECT * FROM j1 WHERE NOT base_failed AND NOT far)")},
{_judge('j2', 'ref2')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT far AS kept, round(char_distance, 6) AS char_distance,
       round(word_distance, 6) AS word_distance
FROM j2
"""

# Fixed values, as in the operator's tables.
_SENTENCES = [
    ("licensed under the apache license version 2 0", "apache2-short"),
    ("licensed under the apache license version 2 0 the license", "apache2-head"),
    ("you may not use this file except in compliance with the license", "apache2-compliance"),
    ("you may obtain a copy of the license at", "apache2-copy"),
    ("released under the mit license", "mit-short"),
    ("this project is licensed under the mit license", "mit-short"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-grant"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit-notice"),
    ("this work is licensed under the gnu general public license version 3", "gpl3-short"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-grant"),
    ("either version 3 of the license or at your option any later version", "gpl3-later"),
    ("either version 2 of the license or at your option any later version", "gpl2-later"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4"),
    ("licensed under cc by 4 0", "cc-by-4"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4"),
    ("this is free and unencumbered software released into the public domain", "unlicense-head"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-grant"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
    ("all rights reserved", "all-rights"),
]
_RULES = [
    ("Apache-2.0", "apache2-head apache2-compliance apache2-copy"), ("Apache-2.0", "apache2-short apache2-compliance"),
    ("MIT", "mit-grant mit-notice"), ("GPL-3.0-or-later", "gpl-grant gpl3-later"),
    ("GPL-2.0-or-later", "gpl-grant gpl2-later"), ("BSD-3-Clause", "bsd-grant bsd-endorse"),
    ("BSD-2-Clause", "bsd-grant"), ("Apache-2.0", "apache2-head"), ("Apache-2.0", "apache2-short"),
    ("MIT", "mit-short"), ("MIT", "mit-grant"), ("GPL-3.0-only", "gpl3-short"), ("GPL-2.0-or-later", "gpl-grant"),
    ("CC-BY-NC-4.0", "cc-by-nc-4"), ("CC-BY-SA-4.0", "cc-by-sa-4"), ("CC-BY-4.0", "cc-by-4"),
    ("Unlicense", "unlicense-head"),
]
_PATTERNS = [(name, "(.*?)".join(f";{x};" for x in ids.split()),
              "".join(f"\\{i + 1}" for i in range(len(ids.split()) - 1))) for name, ids in _RULES]

ORACLE["op1_license_scan"] = rf"""
WITH known(sentence, id) AS (VALUES {', '.join(f"('{s}', '{i}')" for s, i in _SENTENCES)}),
cut AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents)),
norm AS (SELECT doc_id, i, trim(regexp_replace(lower(part), '[^0-9a-z]+', ' ', 'g')) AS sentence FROM cut),
seq AS (
  SELECT doc_id, count(*) FILTER (WHERE norm.sentence <> '') AS n_sentences,
         coalesce(string_agg(id, ',' ORDER BY i), '') AS ids,
         coalesce(string_agg(';' || id || ';', '' ORDER BY i), '') AS r0
  FROM norm LEFT JOIN known USING (sentence) GROUP BY doc_id),
{', '.join(f"m{k} AS (SELECT *, regexp_replace(r{k}, '{p}', '{g}', 'g') AS r{k + 1}, len(regexp_extract_all(r{k}, '{p}')) AS n{k} FROM {'seq' if not k else f'm{k - 1}'})" for k, (_, p, g) in enumerate(_PATTERNS))},
hits AS (
  SELECT doc_id, n_sentences, ids, r{len(_PATTERNS)} AS rest, {' + '.join(f'n{k}' for k in range(len(_PATTERNS)))} AS n_matches,
         [{', '.join(f"CASE WHEN n{k} > 0 THEN '{name}' END" for k, (name, _, _) in enumerate(_PATTERNS))}] AS names
  FROM m{len(_PATTERNS) - 1})
SELECT doc_id, n_sentences, ids AS sentence_ids,
       coalesce((SELECT string_agg(x, ',' ORDER BY k) FROM (
         SELECT x, min(k) AS k FROM (SELECT unnest(names) AS x, generate_subscripts(names, 1) AS k) WHERE x IS NOT NULL GROUP BY x)), '') AS licenses,
       CAST(n_matches AS BIGINT) AS n_matches, trim(replace(replace(rest, ';;', ','), ';', ''), ',') AS unmatched_ids
FROM hits
"""

ORACLE["op2_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {SPACE_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLE["op3_ngram_jaccard"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = d.doc_id), d.doc_id)) AS component_id,
       (SELECT count(*) FROM ways WHERE ways.a = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id)
"""


def _over(query: str, table: str) -> str:
    """The query's SQL over another documents table."""
    return ORACLE[query].replace("FROM documents", f"FROM {table}")


# The stages in order; each reads what the one before it kept.
PIPELINE = rf"""
WITH k9 AS MATERIALIZED ({ORACLE["op9_quality_rules"]}),
p9 AS MATERIALIZED (SELECT d.* FROM documents d JOIN k9 USING (doc_id) WHERE k9.kept),
k3 AS MATERIALIZED ({_over("op3_ngram_jaccard", "p9")}),
p3 AS MATERIALIZED (SELECT d.* FROM p9 d JOIN k3 USING (doc_id) WHERE k3.component_id = d.doc_id),
tok AS MATERIALIZED (
  SELECT doc_id, regexp_extract(text, '^[\x20\x09-\x0D]*') AS head,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS w FROM p3),
win AS (SELECT doc_id, i, array_to_string(list_transform(w[i:i + 19], lambda x: regexp_extract(x, '^[^\x20\x09-\x0D]+')), ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM tok)),
late AS (SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM tok),
kept AS (SELECT doc_id, string_agg(word, '' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p)
         WHERE doc_id IN (SELECT doc_id FROM gone) GROUP BY doc_id),
p2 AS MATERIALIZED (
  SELECT d.doc_id, CASE WHEN kept.t IS NULL THEN d.text ELSE head || kept.t END AS text, lang, source,
         CASE WHEN kept.t IS NULL THEN n_chars ELSE length(head || kept.t) END AS n_chars
  FROM p3 d JOIN tok USING (doc_id) LEFT JOIN kept USING (doc_id)
  WHERE kept.t IS NOT NULL OR d.doc_id NOT IN (SELECT doc_id FROM gone)),
k10 AS MATERIALIZED ({_over("op10_decontaminate", "p2")}),
p10 AS MATERIALIZED (SELECT d.* FROM p2 d JOIN k10 USING (doc_id) WHERE NOT k10.contaminated),
k4 AS MATERIALIZED ({_over("op4_mix_sources", "p10")})
SELECT p10.*, k4.size, k4.source_size, k4.target,
       CAST(CASE WHEN k4.size > 0 THEN k4.taken // k4.size ELSE 0 END AS BIGINT) AS copies, k4.taken
FROM p10 JOIN k4 USING (doc_id) WHERE k4.taken > 0
"""
