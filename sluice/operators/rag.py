"""RAG assembly: W6 rag_context, F28 chat_messages, W8 last_n, F34
extract_links, F33 page_scrape, ingestion (L2) and collection stats (A1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.functions import html as fh
from sluice.session import write_table

MAX_CONTEXT = 4000


def rag_context(hits: DataFrame, max_len: int = MAX_CONTEXT, title_col: str = "title",
                content_col: str = "content", url_col: str | None = None,
                include_metadata: bool = True) -> DataFrame:
    """One row per query of ``hits``: pieces '[Source: t]\\ncontent\\n' (+ 'URL: u\\n') +
    '---\\n' in rank order while the running length stays <= max_len (the
    first piece that would pass it ends the context); pieces joined by a
    newline. A query whose first piece does not fit gets an empty context.
    Lengths are positive, so the running-sum prefix is that break."""
    piece = F.concat(F.lit("[Source: "), F.coalesce(F.nullif(F.col(title_col), F.lit("")),
                                                    F.lit("Unknown")),
                     F.lit("]\n"), F.coalesce(F.col(content_col), F.lit("")), F.lit("\n"))
    if include_metadata and url_col:
        piece = F.concat(piece, F.when(F.col(url_col).isNotNull() & (F.col(url_col) != ""),
                                       F.concat(F.lit("URL: "), F.col(url_col), F.lit("\n")))
                         .otherwise(F.lit("")))
    piece = F.concat(piece, F.lit("---\n"))
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    run = hits.withColumn("_p", piece).withColumn("_run", F.sum(F.length("_p")).over(w))
    fits = F.col("_run") <= max_len
    return run.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("rank", "_p")))),
                                 lambda x: x["_p"]), "\n").alias("context"),
        F.count_if(fits).alias("pieces"))


def chat_messages(conversations: DataFrame, system_prompt: str | None = None) -> DataFrame:
    """for every user turn the message list [system?] + earlier turns +
    this turn, as array<struct(role, content)> in turn order."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    hist = conversations.withColumn(
        "messages", F.collect_list(F.struct(F.col("role"), F.col("text").alias("content"))).over(w))
    out = hist.filter(F.col("role") == "user")
    if system_prompt:
        out = out.withColumn("messages", F.concat(
            F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content"))),
            F.col("messages")))
    return out.select("conv_id", "turn", "messages")


def last_n(df: DataFrame, key: str, order: str, n: int, tie: str) -> DataFrame:
    """Newest n rows per key; equal times are ordered by ``tie``."""
    w = W.partitionBy(key).orderBy(F.col(order).desc(), F.col(tie).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def extract_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """one row per link (position, text, href)."""
    z = F.arrays_zip(fh.link_hrefs(html_col).alias("href"), fh.link_texts(html_col).alias("text"))
    return (pages.select(id_col, F.posexplode(z).alias("pos", "l"))
            .select(id_col, "pos", F.col("l.text").alias("text"), F.col("l.href").alias("href")))


def page_scrape(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """url -> title, content, link count."""
    return pages.select(id_col, "url", fh.page_title(html_col).alias("title"),
                        fh.html_to_text(html_col).alias("content"),
                        F.size(fh.link_hrefs(html_col)).alias("links"))


def collection_stats(chunks: DataFrame) -> DataFrame:
    """A1: chunks per collection."""
    return chunks.groupBy("collection").agg(F.count("*").alias("chunks"))


def ingest(documents: DataFrame, strategy: str = "hybrid", embed: bool = True,
           doc_col: str = "doc_id", text_col: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """L2 ingestion: documents -> chunks (one of six strategies) -> chunk ids
    -> E1 vectors. Narrow per document; the embedding is computed once per
    distinct chunk text (a hash join on the text digest, J1)."""
    from sluice.functions.vectors import embed as embed_fn
    from sluice.operators.chunking import chunk, with_chunk_id
    keep = list(keep or [])
    c = with_chunk_id(chunk(documents, strategy, doc_col, text_col, keep=keep))
    if not embed:
        return c
    c = write_table(c.withColumn("_h", F.sha2("content", 256)), "ingest-chunks")      # read by both sides
    vecs = c.select("_h", "content").distinct().select("_h", embed_fn("content").alias("embedding"))
    return c.join(vecs, "_h").drop("_h")
