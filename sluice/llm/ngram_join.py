"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct ``SHINGLE``-word shingles as 64-bit hashes
(the whole word sequence if it has fewer words). Two documents link when
100 * intersection >= PERCENT * union. The result names each document's
component under the links and counts its links.

1. Equal sets are one class, named by its smallest id (a sum over hashed
   tokens identifies a set); copies go no further.
2. Tokens that many documents share are counted; they come last in the order
   of tokens, the others in hash order. A class shows only the prefix of its
   tokens: |x| - ceil(0.8 |x|) + l(|x|) of them, with l(n) = 1 + n // SLACK.
   Linked classes x, y share at least min(l(|x|), l(|y|)) prefix tokens.
3. Groups of similar classes: a class joins the smallest class with which it
   shares the most prefix tokens, if they are enough for a link. A large group
   is dealt into blocks of bounded size; blocks are the groups from here on.
4. Token-group matrix: (token, group) for the union of each group's prefix
   tokens. Two groups that have fewer tokens in common than any two of their
   members would need are never opened together.
5. An opened pair of groups meets in one task: each member of one is first
   bounded by its overlap with the other's token union, and only if that is
   large enough compared with the members. The task reports a spanning set of
   the links and the number of links of each member, never the pairs.
6. The links give the components. Two linked classes are in one group, which
   is always opened with itself, or in two groups that 4 opens: no link is
   lost.

Texts move only for opened groups: a bitmap of fixed size keeps all other
documents out of the shuffle.

Defined results: null text and text without words has an empty set and links
with nothing; rows that share an id are one node with the links of all its
rows; a row without id links with nothing and has no component; an empty table
gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import tokens as tk
from sluice.llm.components import components
from sluice.llm.store import materialise

SHINGLE = 5
PERCENT = 80
SLACK = 16
CHUNK_TOKENS = 4 << 20  # tokens that a task counts at a time
COMMON_LOCAL = 2        # documents of one chunk that make a token a candidate
COMMON = 16             # documents that make a token common
MAX_COMMON = 1 << 18    # bound of the broadcast list (the most frequent)
SPLIT = 5000            # documents of one common token in one place
BLOCK_DOCS = 1024       # classes of one group
BLOCK_TOKENS = 400_000  # tokens of one group, but for a single larger class
BITMAP_BITS = 24        # bits of the bitmap of candidate ids, as a power of two
_U = np.uint64


def shingle_hashes(s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, document) of a slice, by position."""
    h = s.hashes()
    at = np.flatnonzero(s.room() >= SHINGLE)
    token, doc = [tk.grams(h, SHINGLE)[at]], [s.doc[at]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(s.counts == k)
        if len(short):
            token.append(tk.grams(h, k)[s.word_off[short]])
            doc.append(short)
    token, doc = np.concatenate(token), np.concatenate(doc)
    order = np.argsort(doc, kind="stable")
    return token[order], doc[order]


def token_sets(s: tk.Slice) -> Iterator[np.ndarray]:
    """Sorted distinct tokens of each document of a slice."""
    token, doc = shingle_hashes(s)
    cut = np.searchsorted(doc, np.arange(s.n_docs + 1))
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield np.unique(token[i:j])


def least_overlap(n: int) -> int:
    """ceil(n * PERCENT / 100): tokens shared with any partner at least."""
    return -(-n * PERCENT // 100)


def prefix_size(n: int) -> int:
    return min(n, n - least_overlap(n) + 1 + n // SLACK)


def least_shared(n: Column) -> Column:
    """Prefix tokens that a set of size ``n`` shares with any partner."""
    return F.floor(F.ceil(n * PERCENT / 100) / SLACK) + 1


def common_tokens(docs: DataFrame, text_col: str, common: int, common_local: int) -> DataFrame:
    """(token, docs) of the most frequent tokens; bounded by MAX_COMMON. The
    list orders tokens; it does not decide what is found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held) if held else np.zeros(0, _U),
                                 return_counts=True)
            many = n >= common_local
            return pa.RecordBatch.from_arrays([pa.array(tk.signed(token[many])), pa.array(n[many])],
                                              names=["token", "n"])
        for b in batches:
            for s in tk.slices(b.column(0), fold=tk.LOWER):
                for t in token_sets(s):
                    held.append(t)
                    size += len(t)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held, size = [], 0
        yield flush()
    return (docs.select(text_col).mapInArrow(run, "token bigint, n bigint")
            .groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= common)
            .orderBy(F.col("n").desc(), "token").limit(MAX_COMMON))


def signatures(docs: DataFrame, id_col: str, text_col: str, tokens: np.ndarray,
               counts: np.ndarray) -> DataFrame:
    """(doc, n, f1, f2, prefix): set size, 128-bit identity and prefix tokens."""
    order = np.argsort(tokens)
    shared = docs.sparkSession.sparkContext.broadcast((tokens[order], counts[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        seen = np.zeros(1 << 22, dtype=bool)
        seen[known >> _U(42)] = True
        for b in batches:
            for s in tk.slices(b.column(1), fold=tk.LOWER):
                n, f1, f2, prefix = [], [], [], []
                for t in token_sets(s):
                    n.append(len(t))
                    f1.append(int(tk.mix(t).sum(dtype=_U).view(np.int64)))
                    f2.append(int(tk.mix(t ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)))
                    maybe = np.flatnonzero(seen[t >> _U(42)])
                    if len(maybe):
                        at = np.minimum(np.searchsorted(known, t[maybe]), len(known) - 1)
                        rank = np.zeros(len(t), dtype=np.int64)
                        rank[maybe] = np.where(known[at] == t[maybe], times[at], 0)
                        t = t[np.argsort(rank, kind="stable")]
                    prefix.append(tk.signed(t[:prefix_size(len(t))]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.first, s.n_docs), pa.array(n, pa.int64()),
                     pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                     pa.array(prefix, pa.list_(pa.int64()))], names=["doc", "n", "f1", "f2", "prefix"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc {kind}, n bigint, f1 bigint, f2 bigint, prefix array<bigint>")


def postings(rows: DataFrame, kind: str) -> DataFrame:
    """(token, doc, n, first) of the tokens that two or more classes hold;
    ``first`` is the smallest class of the token (of the token's part, for a
    split token). One pass over rows sorted by (part, token, doc)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "part", "doc", "n"]
        last: pa.RecordBatch | None = None          # pending row of the token before
        first = None                                # its token's smallest class
        for b in batches:
            b = b.select(names)
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([last, b] if last is not None else [b]).combine_chunks()
            token, part = t["token"].to_numpy(), t["part"].to_numpy()
            same = (token[1:] == token[:-1]) & (part[1:] == part[:-1])
            begins = np.concatenate(([True], ~same))
            held = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            head = t["doc"].combine_chunks().take(pa.array(held))
            goes_on = last is not None and first is not None
            if goes_on:                             # the first group began in an earlier batch
                n_old = int(np.flatnonzero(~same)[0]) + 1 if not same.all() else len(token)
                old = pa.array([first] * n_old, head.type)
                head = pa.concat_arrays([old, head.slice(n_old)])
            several = np.concatenate((same, [False])) | np.concatenate(([goes_on], same)) | (part >= 0)
            out = np.flatnonzero(several[:-1])
            yield pa.RecordBatch.from_arrays(
                [t["token"].combine_chunks().take(pa.array(out)), t["doc"].combine_chunks().take(pa.array(out)),
                 t["n"].combine_chunks().take(pa.array(out)), head.take(pa.array(out))],
                names=["token", "doc", "n", "first"])
            last = t.slice(t.num_rows - 1).to_batches()[0]
            # the pending row's group has an earlier row: it is not alone
            alone = begins[-1] and not (goes_on and len(token) == 1)
            first = None if alone else head[-1].as_py()
        if last is not None and (first is not None or last.column(1)[0].as_py() >= 0):
            yield pa.RecordBatch.from_arrays(
                [last.column(0), last.column(2), last.column(3),
                 pa.array([first if first is not None else last.column(2)[0].as_py()],
                          last.column(2).type)], names=["token", "doc", "n", "first"])
    return rows.mapInArrow(run, f"token bigint, doc {kind}, n bigint, first {kind}")


def maybe_listed(docs: DataFrame, key: str, listed: DataFrame, flag: str) -> DataFrame:
    """``docs`` with a column ``flag``: false if the row's id is not among
    ``listed`` (column id), true if it may be. The ids travel as a bitmap of
    2**BITMAP_BITS bits, at most 2**BITMAP_BITS / 64 broadcast rows."""
    bit = lambda c: F.shiftright(F.xxhash64(c), 64 - BITMAP_BITS - 1).bitwiseAND(
        F.lit((1 << BITMAP_BITS) - 1))
    place, word, bits = tk.unused(docs.columns, "place", "word", "bits")
    words = (listed.select(bit("id").alias("bit"))
             .groupBy(F.shiftright("bit", 6).alias(word))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias(bits)))
    probe = docs.withColumn(place, bit(key))
    met = probe.join(F.broadcast(words), F.shiftright(place, 6) == F.col(word), "left")
    hit = F.expr(f"(shiftright({bits}, cast({place} & 63 as int)) & 1L) = 1")
    return met.select(*docs.columns, F.coalesce(hit, F.lit(False)).alias(flag))


def only_listed(docs: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be among ``listed``; a join follows."""
    flag, = tk.unused(docs.columns, "flag")
    return maybe_listed(docs, key, listed, flag).filter(F.col(flag)).drop(flag)


class Member:
    """Sets of one side of an opened pair: tokens by place."""

    def __init__(self, ids: list, sizes: list[int], sets: list[np.ndarray]):
        self.ids, self.weights, self.sets = ids, np.array(sizes), sets
        self.lengths = np.array([len(x) for x in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, _U)
        order = np.argsort(flat, kind="stable")
        self.union, first = np.unique(flat[order], return_index=True)
        self.owner = np.repeat(np.arange(len(sets)), self.lengths)[order]
        self.begin = np.append(first, len(flat))

    def overlaps(self, x: np.ndarray) -> np.ndarray | None:
        """Tokens that ``x`` shares with each set; None if the union of all
        holds too few of them for any link."""
        at = np.minimum(np.searchsorted(self.union, x), len(self.union) - 1)
        at = at[self.union[at] == x]
        if len(at) < least_overlap(len(x)):
            return None
        size = self.begin[at + 1] - self.begin[at]
        place = np.arange(size.sum()) + np.repeat(self.begin[at] - (np.cumsum(size) - size), size)
        return np.bincount(self.owner[place], minlength=len(self.sets))


def compare(a: Member, b: Member | None) -> tuple[list, list, list]:
    """Links of ``a`` with ``b``, or inside ``a``: (node, partner) of a
    spanning set, and (node, None, links) of each linked member."""
    other = a if b is None else b
    n_a = len(a.sets)
    root = list(range(n_a + (0 if b is None else len(other.sets))))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    count = [np.zeros(n_a, dtype=np.int64), np.zeros(len(other.sets), dtype=np.int64)]
    node, partner, links = [], [], []
    shift = 0 if b is None else n_a
    for i, x in enumerate(a.sets):
        both = other.overlaps(x)
        if both is None:
            continue
        linked = 100 * both >= PERCENT * (len(x) + other.lengths - both)
        if b is None:
            linked[i:] = False              # each pair once
        for j in np.flatnonzero(linked).tolist():
            if a.ids[i] == other.ids[j]:
                continue                    # rows of one node
            count[0][i] += other.weights[j]
            count[1][j] += a.weights[i]
            u, v = find(i), find(j + shift)
            if u != v:
                root[u] = v
                node.append(a.ids[i])
                partner.append(other.ids[j])
                links.append(0)
    for side, c in ((a, count[0]), (other, count[1])):
        for i in np.flatnonzero(c).tolist():
            node.append(side.ids[i])
            partner.append(None)
            links.append(int(c[i]))
    return node, partner, links


def find_links(opened: DataFrame, members: DataFrame, docs: DataFrame, id_col: str, text_col: str,
               kind: str) -> DataFrame:
    """(a, b, links): spanning links (a, b, 0) and link counts (a, null, n) of
    the opened pairs of groups (g, h)."""
    side = lambda c, name: opened.join(members.withColumnRenamed("group", c), c).select(
        "g", "h", F.lit(name).alias("side"), "doc", "size")
    rows = side("g", 0).unionByName(side("h", 1).filter("g <> h"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    texts = only_listed(texts, "doc", members.select(F.col("doc").alias("id")))
    both = (rows.join(texts, "doc").repartition("g", "h").sortWithinPartitions("g", "h", "side", "doc")
            .select("g", "h", "side", "doc", "size", "text"))

    def read(rows: list[pa.RecordBatch], want: int) -> Member:
        t = pa.Table.from_batches(rows).combine_chunks()
        t = t.filter(pa.array(t["side"].to_numpy() == want)).combine_chunks()
        sets = []
        for c in t["text"].chunks:
            for s in tk.slices(c, fold=tk.LOWER):
                sets += list(token_sets(s))
        return Member(t["doc"].to_pylist(), t["size"].to_pylist(), sets)

    def judge(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        one = held[0].column(0)[0].as_py() == held[0].column(1)[0].as_py()
        node, partner, links = compare(read(held, 0), None if one else read(held, 1))
        names = held[0].schema.field("doc").type
        return pa.RecordBatch.from_arrays([pa.array(node, names), pa.array(partner, names),
                                           pa.array(links, pa.int64())], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            g, h = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (h[1:] != h[:-1])) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (g[i], h[i]):
                    yield judge(held)
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield judge(held)
    return both.mapInArrow(run, f"a {kind}, b {kind}, links bigint")


def link_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    common: int = COMMON, common_local: int = COMMON_LOCAL, split: int = SPLIT,
                    block_docs: int = BLOCK_DOCS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (the smallest id
    reachable by links) and n_links (documents it links with). ``common`` and
    the other numbers spread the work and do not change results."""
    kind = docs.schema[id_col].dataType.simpleString()
    often = materialise(common_tokens(docs, text_col, common, common_local), "join-common")
    listed = often.toPandas()                        # at most MAX_COMMON rows
    sigs = materialise(signatures(docs, id_col, text_col,
                                  listed["token"].to_numpy(np.int64).view(_U),
                                  listed["n"].to_numpy(np.int64)), "join-signatures")
    real = sigs.filter((F.col("n") > 0) & F.col("doc").isNotNull())

    # 1. one class per distinct set, with its prefix
    classes = (real.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc", "prefix")).alias("m"))
               .select("m.doc", "n", F.explode("m.prefix").alias("token")))
    parts = F.ceil(F.col("times") / split)
    part = F.when(F.col("times") > split, F.pmod(F.xxhash64("doc"), parts)).otherwise(-1)
    rows = (classes.join(F.broadcast(often.withColumnRenamed("n", "times")), "token", "left")
            .select("token", "doc", "n", F.coalesce(part, F.lit(-1)).cast("bigint").alias("part")))
    rows = rows.repartition("token", "part").sortWithinPartitions("token", "part", "doc")
    shared = materialise(postings(rows, kind), "join-postings")

    # 3. groups of bounded size
    alike = (shared.groupBy("doc", "n", "first").agg(F.count("*").alias("c"))
             .filter(F.col("c") >= least_shared(F.col("n")))
             .groupBy("doc").agg(F.max(F.struct("c", (-F.hash("first")).alias("tie"), "first"))["first"]
                                 .alias("key")))
    sizes = real.groupBy("f1", "f2", "n").agg(F.min("doc").alias("doc"), F.count("*").alias("size"))
    named = (shared.select("doc").distinct().join(alike, "doc", "left")
             .join(sizes.select("doc", "n", "size"), "doc")
             .select("doc", "n", "size", F.coalesce("key", "doc").alias("key")))
    named = materialise(named, "join-keys")
    blocks = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_tokens), F.lit(1))
    members = named.join(named.groupBy("key").agg(blocks.alias("blocks")), "key").select(
        "doc", "n", "size", F.xxhash64("key", F.pmod(F.xxhash64("doc"), F.col("blocks"))).alias("group"))
    members = materialise(members, "join-members")

    # 4. token-group matrix over the tokens that different groups hold
    place = members.select("doc", "group").distinct()
    matrix = shared.select("token", "doc").join(place, "doc").select("token", "group").distinct()
    groups = members.groupBy("group").agg(F.min("n").alias("least"), F.count("*").alias("docs"))
    mixed = matrix.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1").select("token")
    matrix = materialise(matrix.join(mixed, "token"), "join-matrix")
    pairs = (matrix.select("token", F.col("group").alias("g"))
             .join(matrix.select("token", F.col("group").alias("h")), "token").filter("g < h")
             .groupBy("g", "h").agg(F.count("*").alias("c")))
    low = lambda c: groups.select(F.col("group").alias(c), F.col("least").alias(f"least_{c}"))
    across = (pairs.join(low("g"), "g").join(low("h"), "h")
              .filter(F.col("c") >= F.floor(F.least("least_g", "least_h") / SLACK) + 1).select("g", "h"))
    inside = groups.filter("docs > 1").select(F.col("group").alias("g"), F.col("group").alias("h"))
    opened = materialise(across.unionByName(inside), "join-opened")

    # 5. links of the opened groups
    seen = opened.select(F.explode(F.array("g", "h")).alias("group")).distinct()
    found = materialise(find_links(opened, members.join(seen, "group").select("doc", "size", "group"),
                                   docs, id_col, text_col, kind), "join-links")
    labels = materialise(components(found.filter(F.col("b").isNotNull()).select("a", "b")),
                         "join-components")
    counted = found.filter(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("links"))

    # 6. every document: its class, the class's component and links
    reps = (sizes.join(labels, F.col("doc") == F.col("node"), "left")
            .join(counted, F.col("doc") == F.col("a"), "left")
            .select("f1", "f2", "n", F.coalesce("label", "doc").alias("component_id"),
                    (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    linked = real.join(reps, ["f1", "f2", "n"]).select("doc", "n", "component_id", "n_links")
    alone = sigs.filter((F.col("n") == 0) | F.col("doc").isNull()).select(
        "doc", "n", F.col("doc").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(alone).select(F.col("doc").alias(id_col),
                                            F.col("n").alias("n_shingles"), "component_id", "n_links")


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, repeated rows
    (same id, same text) once; rows without id stay. Only documents whose id
    may be one to drop or repeated are shuffled."""
    found = materialise(link_components(docs, id_col=id_col, text_col=text_col), "join-found")
    ids = found.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col("component_id") != F.col(id_col)).alias("gone"), F.count("*").alias("rows"))
    ids = materialise(ids.filter(F.col("id").isNotNull() & (F.col("gone") | (F.col("rows") > 1))), "join-drop")
    listed, digest, copy = tk.unused(docs.columns, "listed", "digest", "copy")
    flagged = maybe_listed(docs, id_col, ids, listed)
    plain = flagged.filter(~F.col(listed)).select(*docs.columns)
    first = F.row_number().over(Window.partitionBy(id_col, digest).orderBy(digest))
    rest = (flagged.filter(F.col(listed)).withColumn(digest, F.xxhash64(text_col))
            .join(ids.filter("gone").select(F.col("id").alias(id_col)), id_col, "left_anti")
            .withColumn(copy, first).filter((F.col(copy) == 1) | F.col(id_col).isNull()))
    return plain.unionByName(rest.select(*docs.columns))
