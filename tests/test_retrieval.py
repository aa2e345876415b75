"""Retrieval: paging fixture of the reference, kNN against brute force,
metadata filter folding, rerank ties, RAG context limits."""

import numpy as np
from pyspark.sql import functions as F

from sluice.operators import rag, retrieval as rt
from sluice.operators import vector_index as vi

SF = "/root/testdata/sf0.001"


def test_paging_fixture(spark):
    # 20 hits of score 0.9, limit 5, offset 10, default threshold 0.7
    rows = [(1, i, f"doc {i}", 0.9, i + 1) for i in range(20)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_index long, content string, "
                                       "similarity_score double, rank int")
    # the reference test mocks the vector service, so no rerank is applied
    page = rt.page_hits(hits, limit=5, offset=10, threshold=0.7,
                        do_rerank=False).orderBy("position").collect()
    assert len(page) == 5
    assert page[0]["total_results"] == 20
    assert page[0]["chunk_index"] == 10


def test_threshold_counts_survivors_only(spark):
    rows = [(1, i, "x" * 500, 0.9 if i < 3 else 0.5, i + 1) for i in range(6)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_index long, content string, "
                                       "similarity_score double, rank int")
    page = rt.page_hits(hits, limit=5, offset=0, threshold=0.7).collect()
    assert {r["total_results"] for r in page} == {3}


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    corpus = rng.normal(size=(300, 8)).astype("float32")
    queries = rng.normal(size=(7, 8)).astype("float32")
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)],
                                "chunk_id long, embedding array<float>").repartition(5)
    qdf = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(queries)],
                                "query_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.chunk_id for r in rt.knn_join(qdf, cdf, 4).collect()}
    c = corpus.astype(float) / np.linalg.norm(corpus.astype(float), axis=1)[:, None]
    q = queries.astype(float) / np.linalg.norm(queries.astype(float), axis=1)[:, None]
    s = q @ c.T
    for i in range(len(queries)):
        best = np.lexsort((np.arange(len(corpus)), -s[i]))[:4]
        for r, j in enumerate(best):
            assert got[(100 + i, r + 1)] == j


def test_knn_ties_break_on_id(spark):
    cdf = spark.createDataFrame([(i, [1.0, 0.0]) for i in [5, 3, 9, 1]],
                                "chunk_id long, embedding array<float>").repartition(3)
    qdf = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = [r.chunk_id for r in rt.knn_join(qdf, cdf, 2).orderBy("rank").collect()]
    assert got == [1, 3]


def test_knn_query_blocks(spark):
    # small blocks meet pair by pair; result unchanged
    rng = np.random.default_rng(2)
    cdf = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)],
                                "chunk_id long, embedding array<double>")
    qdf = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)],
                                "query_id long, embedding array<double>")
    a = sorted(map(tuple, rt.knn_join(qdf, cdf, 3).select("query_id", "chunk_id", "rank").collect()))
    b = sorted(map(tuple, rt.knn_join(qdf, cdf, 3, max_broadcast=0, block_queries=2, block_chunks=7)
                   .select("query_id", "chunk_id", "rank").collect()))
    assert a == b


def plan_of(df):
    import io
    from contextlib import redirect_stdout
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_corpus_vectors_are_not_shuffled(spark):
    from sluice.plans import inputs as inp
    q, c = inp.vector_queries(spark, SF), inp.vectors(spark, SF)
    for df in (rt.knn_join(q, c, 5), rt.similar_chunks(c, 5, queries=c.filter("chunk_id % 50 = 0")),
               rt.search_page(q, c, texts=inp.vector_texts(spark, SF))):
        plan = plan_of(df)
        assert "MapInArrow" in plan and "CoGroup" not in plan
        exchanges = [x for x in plan.split("\n\n") if " Exchange" in x.split("\n")[0]]
        assert exchanges and not any("embedding" in x for x in exchanges)


def test_scan_keeps_ties_strings_and_odd_rows(spark):
    rows = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0, None]), ("f", [1.0]),
            ("é", [3.0, 0.0]), ("g", [0.0, 1.0]), ("z", [1.0, 0.0, 0.0])]
    cdf = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(4)
    qdf = spark.createDataFrame([(1, [5.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 2.0, 0.0])],
                                "query_id int, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.chunk_id) for r in rt.knn_join(qdf, cdf, 3).collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "é"), (4, 1, "z")]
    assert rt.knn_join(qdf.limit(0), cdf, 3).count() == rt.knn_join(qdf, cdf.limit(0), 3).count() == 0


def test_running_top_k_equals_a_full_sort():
    rng = np.random.default_rng(3)
    for k in (1, 3, 40):
        top, every = rt.TopK(5, k), []
        for _ in range(12):
            rows = np.sort(rng.choice(5, rng.integers(1, 6), replace=False))
            ids = rng.choice(10_000, rng.integers(1, 30), replace=False)
            score = rng.integers(0, 6, (len(rows), len(ids))) / 5          # many ties
            score[rng.random(score.shape) < 0.1] = -np.inf
            top.add(rows, score, ids)
            every += [(r, -s, i) for r, x in zip(rows.tolist(), score) for s, i in zip(x, ids.tolist()) if np.isfinite(s)]
        want = [x for r in range(5) for x in sorted(e for e in every if e[0] == r)[:k]]
        assert sorted(zip(top.row.tolist(), (-top.score).tolist(), top.id.tolist())) == want


def clustered(n, seed=0, dim=16, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, dim))


def test_cells_find_neighbours_with_few_pairs(spark):
    v = clustered(4000)
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>").repartition(6)
    q = c.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    index = vi.build(c)
    assert index.chunks.count() == 4000 == sum(index.sizes.values())        # every chunk in one cell
    assert index.chunks.select("chunk_id").distinct().count() == 4000
    found, pairs = vi.search(index, q, 10)
    exact = rt.knn_join(q, c, 10)
    assert rt.recall_at_k(found, exact).first().recall >= 0.9
    assert vi.touched_share(index, q.count(), pairs) < 0.2                 # against 0.64 by hyperplanes
    home = {r.chunk_id: r.cell for r in index.chunks.collect()}
    assert {home[r.chunk_id] for r in found.collect()} <= set(index.sizes)
    # parts of the query set, one after the other: the same hits
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id) for r in df.collect())
    small, again = vi.search(index, q, 10, max_broadcast=5000)
    assert key(small) == key(found) and again == pairs
    # asking every cell is the exact join
    assert key(vi.search(index, q, 10, probes=10_000)[0]) == key(exact)


def test_hot_cells_are_split_and_odd_rows_indexed(spark):
    v = np.concatenate([np.ones((600, 4)), clustered(300, 2, 4)])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(9000, None), (9001, [0.0] * 4), (9002, [1.0] * 3), (9003, [1.0, None, 0.0, 0.0]), (9004, [])]
    c = spark.createDataFrame(rows + odd, "chunk_id long, embedding array<double>").repartition(5)
    index = vi.build(c, cell_rows=50)
    hot = max(index.sizes, key=index.sizes.get)
    files = [f for f in index.chunks.filter(F.col("cell") == hot).inputFiles() if f"cell={hot}/" in f]
    assert index.sizes[hot] >= 600 and len(files) >= 12 and index.sizes[-1] == 4
    q = spark.createDataFrame([(1, [1.0] * 4), (2, [0.0] * 4), (3, None), (4, [1.0])], "query_id long, embedding array<double>")
    hits = vi.search(index, q, 5)[0].collect()
    assert {r.query_id for r in hits} == {1} and [r.chunk_id for r in hits] == [0, 1, 2, 3, 4]
    for empty in (c.limit(0), c.filter("chunk_id = 9001")):
        assert vi.knn_approx(q, empty, 5).count() == 0


def test_metadata_filter_folding(spark):
    assert rt.metadata_filter({}) is None
    assert rt.metadata_filter({"lang": [1, 2]}) is None          # list without strings
    assert rt.metadata_filter({"x": None}) is None                 # other types ignored
    df = spark.createDataFrame([(1, "en", 1), (2, "de", 0), (3, "fr", 1)],
                               "id int, lang string, flag int")
    flags = spark.createDataFrame([(1, True), (2, False)], "id int, flag boolean")
    assert [r.id for r in rt.apply_filter(flags, {"flag": True}).collect()] == [1]
    f = rt.metadata_filter({"lang": ["en", "fr", 3], "flag": True})
    assert sorted(r.id for r in df.filter(f).collect()) == [1, 3]


def test_rerank_lengths_and_ties(spark):
    rows = [(1, 1, "a" * 499, 0.9, 1), (1, 2, "b" * 500, 0.9, 2), (1, 3, "c" * 501, 0.9, 3)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id long, content string, "
                                       "similarity_score double, rank int")
    out = {r.chunk_id: r for r in rt.rerank(hits).collect()}
    assert out[2].similarity_score == out[3].similarity_score == 0.9
    assert out[1].similarity_score < 0.9
    assert out[2].rank == 1 and out[3].rank == 2 and out[1].rank == 3


def test_rag_context_limit(spark):
    # piece = "[Source: t]\n" + content + "\n---\n"; len = 12 + n + 5
    n = 4000 - 17
    rows = [(1, 1, "t", "x" * n), (1, 2, "t", "y")]
    hits = spark.createDataFrame(rows, "query_id long, rank int, title string, content string")
    ctx = rag.rag_context(hits).collect()[0]
    assert ctx.pieces == 1 and len(ctx.context) == 4000
    rows = [(1, 1, "t", "x" * (n + 1))]
    hits = spark.createDataFrame(rows, "query_id long, rank int, title string, content string")
    none = rag.rag_context(hits).collect()
    assert [(r.context, r.pieces) for r in none] == [("", 0)]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert "query_id" in df.columns


def test_registry_shapes():
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 90


def test_scores_at_hand_are_bounded(spark):
    """The memory of a scan and of a meeting of blocks does not grow with the
    rows of a batch."""
    import tracemalloc

    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql import types as T
    from sluice.operators import retrieval as rt
    r = np.random.default_rng(1)
    asked, chunks = r.normal(size=(1024, 8)), r.normal(size=(16384, 8))
    asked[5], chunks[7], chunks[9] = chunks[3], chunks[3], 0.0

    class Frame:
        schema = T.StructType([T.StructField("chunk_id", T.LongType())])

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    class Shared:
        value = {8: rt.QuerySet(np.arange(1024), asked)}
    run = rt.scan_topk(Frame(), Shared, 3, cid="chunk_id", cvec="v", query_type=T.LongType())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(16384)), pa.array(list(chunks))], names=["chunk_id", "v"])
    q = pd.DataFrame({"query_id": np.arange(1024), "_v": list(asked)})
    c = pd.DataFrame({"chunk_id": np.arange(16384), "_v": list(chunks)})

    def peak(f):
        tracemalloc.start()
        out = f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most
    scanned, most = peak(lambda: pa.Table.from_batches(run(iter([batch]))).to_pandas())
    assert most < 80 << 20
    met, most = peak(lambda: rt._score_blocks(3, "query_id", "chunk_id", False)(q, c))
    assert most < 80 << 20
    s = (1 + (asked / np.linalg.norm(asked, axis=1)[:, None]) @ (
        chunks / np.maximum(np.linalg.norm(chunks, axis=1), 1e-300)[:, None]).T) / 2
    s[:, 9] = -1
    for got in (scanned, met):
        got = got.sort_values(["query_id", "similarity_score", "chunk_id"], ascending=[True, False, True])
        assert len(got) == 3 * 1024
        best = np.sort(s, axis=1)[:, :-4:-1].ravel()
        assert np.allclose(got["similarity_score"], best, atol=1e-12)
        assert {3, 7} <= set(got[got["query_id"] == 5]["chunk_id"])
