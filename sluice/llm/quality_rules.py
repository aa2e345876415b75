"""Quality rules: distribution divergence from language references.

DataFrame operations only. Each document gets two histograms: its characters
by class and its words by common word of its language. Both are compared with
the pooled histogram of the documents of the same language (the reference)
by Jensen-Shannon distance (base 2, 0 to 1). Short documents are guarded: the
characters of a text of fewer than ``MIN_CHARS`` and the words of a text of
fewer than ``MIN_WORDS`` are not judged; where both are, their mean has a
tighter bound. References are pooled over all documents of a language that
pass the base rules, so no single document or sample decides.

The common words of four languages are given. Those of any other language with
at least ``MIN_DOCS`` documents are the words that most of its documents hold,
counted over all of them (``learned_words``).

The base rules count words, symbols, repeated lines and words in repeated
8-word windows inside each document. Repeats are found in the row: words are
hashed once, hashes of 2, 4 and 8 words are combined from neighbours, and only
where two windows are equal their sorted neighbours are looked at.

Texts are read once (those of other languages once more); the histograms (a
few numbers a document) are written and read again for the references.
References are one row per language.

Defined results: null text is empty text, which fails the base rules; a null
language is a language of its own whose words are not judged (it may be many
languages); a language without a reference (no document passes the base rules)
judges nothing; a text without a letter has no common word; repeated rows give
repeated results; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.store import materialise

SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_BASE_WORDS = 20
REPEAT_PERCENT = 30
MIN_CHARS = 200
MIN_WORDS = 40
MIN_DOCS = 20                   # of a language whose common words are learned
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.42
MAX_MEAN_DISTANCE = 0.22

# Characters that each class keeps (regular expression classes).
CLASSES = [("upper", r"\p{Lu}"), ("lower", r"\p{Ll}"), ("digit", "0-9"),
           ("space", SPACE_CLASS), ("stop", r".,;:!?'\"()\-"), ("symbol", SYMBOLS)]
# Common words by language.
COMMON = {
    "de": ["das", "den", "der", "des", "die", "ein", "ist", "mit", "und", "von", "zu"],
    "en": ["a", "and", "for", "in", "is", "it", "of", "on", "that", "the", "to"],
    "es": ["de", "del", "el", "en", "la", "las", "los", "para", "por", "que", "y"],
    "fr": ["de", "des", "du", "en", "et", "la", "le", "les", "que", "un", "une"],
}
N_WORD_BINS = max(len(v) for v in COMMON.values())


def letter_words(text: str) -> Column:
    """Runs of letters, lower case."""
    runs = F.split(F.regexp_replace(F.lower(text), F.lit(r"[^\p{L}]+"), F.lit(" ")), F.lit(" "))
    return F.filter(runs, lambda t: t != "")


def learned_words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, words): the words held by most documents of each language that
    ``COMMON`` does not list, in code point order. Ties go to the smaller word."""
    d = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    d = d.filter(~F.col("lang").isin(list(COMMON)))
    held = (d.select("lang", F.explode(F.array_distinct(letter_words("text"))).alias("word"))
            .groupBy("lang", "word").count())
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = held.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= N_WORD_BINS)
    enough = d.groupBy("lang").count().filter(F.col("count") >= MIN_DOCS).select("lang")
    return (top.groupBy("lang").agg(F.array_sort(F.collect_list("word")).alias("words"))
            .join(enough, "lang"))


def doubled(hashes: str, words: int) -> Column:
    """Hashes of ``2 * words`` words from those of ``words`` words."""
    n = F.greatest(F.size(hashes) - words, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(words + 1), n),
                      lambda a, b: F.xxhash64(a, b))


def histograms(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Per document: row, lang, base counts, character classes and common words."""
    d = docs.select("row", F.col(lang_col).cast("string").alias("lang"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(SPACES))
    d = d.withColumn("w", F.when(bare == "", F.array().cast("array<string>"))
                     .otherwise(F.split(bare, F.lit(f"[{SPACE_CLASS}]+"))))
    d = d.withColumn("lines", F.filter(F.split("text", F.lit("\n")),
                                       lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    d = d.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    for words in (1, 2, 4):
        d = d.withColumn("h", doubled("h", words))
    left = lambda keep_class: F.length(
        F.regexp_replace("text", F.lit(f"[^{keep_class}]+"), F.lit(""))).cast("bigint")
    every = sorted({w for v in COMMON.values() for w in v})
    listed = F.coalesce(F.col("lang").isin(list(COMMON)), F.lit(False))
    d = d.select(
        "row", "lang", F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        left(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        # (hash, start) in hash order, only for texts that repeat a window:
        # starts with an equal neighbour repeat; in text order each covers the
        # words, at most WINDOW, that the one before it does not
        F.when(F.size(F.array_distinct("h")) < F.size("h"),
               F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .alias("sorted"),
        F.length("text").cast("bigint").alias("chars"),
        F.array(*[left(c) for _, c in CLASSES]).alias("classes"),
        letter_words("text").alias("tokens"))
    neighbours = F.zip_with(
        F.slice("sorted", F.lit(1), F.size("sorted") - 1), F.slice("sorted", F.lit(2), F.size("sorted") - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(neighbours, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda s, x: F.struct(x.alias("last"),
                              (s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n")),
        lambda s: s["n"])
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    common = spaced(F.filter("tokens", lambda t: t.isin(every)))
    learned = docs.select(lang_col).filter(~F.col(lang_col).cast("string").isin(list(COMMON)))
    if learned.isEmpty():
        d = d.withColumn("known", F.lit(None).cast("array<string>"))
    else:
        words = materialise(learned_words(docs, text_col, lang_col), "quality-words")
        d = d.join(words.select("lang", F.col("words").alias("known")), "lang", "left")
        common = F.when(listed, common).when(F.col("known").isNotNull(), spaced(F.col("tokens")))
    d = d.select("row", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                 F.coalesce(F.when(F.col("sorted").isNotNull(), covered), F.lit(0)).cast("bigint")
                 .alias("n_repeat_words"), "chars", "classes",
                 F.size("tokens").cast("bigint").alias("n_tokens"), common.alias("common"), "known")
    count = lambda w: ((F.length("common") - F.length(
        F.replace("common", F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)).cast("bigint")
    bins = F.coalesce(F.transform("known", count), F.array().cast("array<bigint>"))
    for lang, words in COMMON.items():
        bins = F.when(F.col("lang") == lang, F.array(*[count(F.lit(w)) for w in words])).otherwise(bins)
    return d.withColumn("words", bins).drop("common", "known")


def with_rest(bins: Column, total: Column) -> Column:
    """The histogram with a last bin for everything else."""
    return F.concat(bins, F.array(total - F.aggregate(bins, F.lit(0).cast("bigint"),
                                                      lambda a, x: a + x)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of equal length,
    given as shares."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def shares(bins: Column, total: Column) -> Column:
    return F.transform(bins, lambda x: x / total)


def quality(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text",
            lang_col: str = "lang", max_char: float = MAX_CHAR_DISTANCE,
            max_word: float = MAX_WORD_DISTANCE, max_mean: float = MAX_MEAN_DISTANCE) -> DataFrame:
    """Columns ``keep`` (default: all) and, per document: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance (null where the length guard holds) and kept.

    Columns of ``docs`` with one of these names are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "char_distance", "word_distance", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(True)
    h = histograms(docs.select(row.alias("row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")),
                   "text", "lang")
    h = h.withColumn("classes", with_rest(F.col("classes"), F.col("chars")))
    h = h.withColumn("words", with_rest(F.col("words"), F.col("n_tokens")))
    h = h.withColumn("base_failed", (F.col("n_words") < MIN_BASE_WORDS)
                     | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))
    h = materialise(h, "quality-histograms")
    bounds = (max_char, max_word, max_mean)
    plain = h.filter(~F.col("base_failed"))
    near = distances(plain, references(plain), *bounds).filter(~F.col("far"))
    j = distances(h, materialise(references(near), "quality-references"), *bounds)
    return j.select(*(["row.*"] if keep else []), *new[:-1],
                    (~F.col("base_failed") & ~F.col("far")).alias("kept"))


def references(h: DataFrame) -> DataFrame:
    """One row per language: pooled class shares ``rc`` and word shares ``rw``."""
    n_classes = len(CLASSES) + 1
    pool = h.groupBy("lang").agg(
        *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n_classes)],
        *[F.sum(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(N_WORD_BINS + 1)])
    c = F.array(*[F.col(f"c{i}") for i in range(n_classes)])
    w = F.filter(F.array(*[F.col(f"w{i}") for i in range(N_WORD_BINS + 1)]), lambda x: x.isNotNull())
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return pool.select("lang", shares(c, add(c)).alias("rc"),
                       F.when(add(w) > 0, shares(w, add(w))).alias("rw"))


def distances(h: DataFrame, refs: DataFrame, max_char: float, max_word: float,
              max_mean: float) -> DataFrame:
    """``h`` with char_distance, word_distance and ``far`` (either, or their
    mean, too large; a null distance is not judged)."""
    j = h.alias("d").join(refs.alias("r"), F.col("d.lang").eqNullSafe(F.col("r.lang")), "left")
    char = F.when((F.col("chars") >= MIN_CHARS) & F.col("rc").isNotNull(),
                  js_distance(shares(F.col("classes"), F.col("chars")), F.col("rc")))
    # one bin: no common words are known for the language
    word = F.when((F.col("n_words") >= MIN_WORDS) & (F.size("rw") > 1),
                  js_distance(shares(F.col("words"), F.greatest("n_tokens", F.lit(1))), F.col("rw")))
    j = j.select("d.*", char.alias("char_distance"), word.alias("word_distance"))
    mean = (F.col("char_distance") + F.col("word_distance")) / 2
    return j.withColumn("far", F.coalesce(F.col("char_distance") > max_char, F.lit(False))
                        | F.coalesce(F.col("word_distance") > max_word, F.lit(False))
                        | F.coalesce(mean > max_mean, F.lit(False)))
