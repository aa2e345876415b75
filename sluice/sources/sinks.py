"""Sinks and table maintenance: chunk collections (SRC10, SRC11), ingest
report (SRC12), audit log (SRC14), metrics exposition text (SRC15), JSON
records (SRC16), business event append (SRC17), deletes and upserts
(SRC18-SRC20).

Plain Parquet has no transactions. The functions here give the changed rows as a
DataFrame; ``collections.ChunkTable`` applies deletes and upserts to a written
collection by merge on read, so that a change writes what it changes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_CHUNK_FIELDS = [
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("collection", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("start_char", T.IntegerType()),
    T.StructField("end_char", T.IntegerType()),
    T.StructField("tokens_count", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("document_type", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("language", T.StringType()),
]

_TYPES = {"string": T.StringType(), "text": T.StringType(), "int": T.LongType(),
          "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.TimestampType(),
          "string[]": T.ArrayType(T.StringType())}


def collection_schema(custom_fields: dict[str, str] | None = None) -> T.StructType:
    """SRC11: base chunk schema plus typed custom fields."""
    extra = [T.StructField(k, _TYPES[v]) for k, v in (custom_fields or {}).items()]
    return T.StructType(BASE_CHUNK_FIELDS + extra)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SRC11: the columns of a collection schema, cast; missing ones null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def prepare_chunks(chunks: DataFrame) -> DataFrame:
    """SRC10 row shaping: missing string metadata -> '' (extra fields kept)."""
    strings = [f.name for f in chunks.schema.fields if isinstance(f.dataType, T.StringType)]
    return chunks.na.fill("", subset=strings)


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """SRC10: append chunks to their collection (partition column)."""
    prepare_chunks(chunks).write.mode(mode).partitionBy("collection").parquet(path)


def ingest_report(chunks: DataFrame, files: DataFrame, file_col: str = "doc_id") -> DataFrame:
    """SRC12: per file success and chunks_created (files without chunks
    report 0); totals come from ``ingest_totals``."""
    per = chunks.groupBy(file_col).agg(F.count("*").alias("chunks_created"))
    return (files.select(file_col).join(per, file_col, "left")
            .select(file_col, F.coalesce("chunks_created", F.lit(0)).alias("chunks_created"),
                    F.lit(True).alias("success")))


def ingest_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if("success").alias("ingested_count"),
                      F.sum("chunks_created").alias("chunk_count"))


def audit_sink(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """SRC14: append-only audit rows partitioned by date."""
    (rows.withColumn("date", F.to_date(F.col(ts))).write.mode("append")
     .partitionBy("date").parquet(path))


def prom_text(metrics: DataFrame, name: str = "metric", labels: str = "labels",
              value: str = "value") -> Column:
    """SRC15: exposition line ``name{k="v",...} value`` (labels sorted)."""
    entries = F.array_sort(F.map_entries(F.col(labels)))
    body = F.array_join(F.transform(entries, lambda e: F.format_string('%s="%s"', e["key"],
                                                                        e["value"])), ",")
    return F.concat(F.col(name), F.when(F.size(entries) > 0, F.concat(F.lit("{"), body, F.lit("}")))
                    .otherwise(F.lit("")), F.lit(" "), F.col(value).cast("string"))


def to_json_record(*cols: str) -> Column:
    """SRC16: a record as JSON text (cache value / hit record)."""
    return F.to_json(F.struct(*cols))


def from_json_record(c: Column, schema: T.StructType | str) -> Column:
    return F.from_json(c, schema)


def event_append(rows: DataFrame, kind: str) -> DataFrame:
    """SRC17: typed business event rows with the defaults USD, api, {}."""
    def opt(c, default, t):
        return (F.coalesce(F.col(c), F.lit(default)) if c in rows.columns
                else F.lit(default)).cast(t)
    return rows.select(
        F.lit(kind).alias("kind"), F.col("user_id"), F.col("ts"),
        (F.col("action") if "action" in rows.columns else F.lit(None)).cast("string").alias("action"),
        (F.col("feature") if "feature" in rows.columns else F.lit(None)).cast("string").alias("feature"),
        (F.col("amount") if "amount" in rows.columns else F.lit(None)).cast("double").alias("amount"),
        opt("currency", "USD", "string").alias("currency"),
        opt("source", "api", "string").alias("source"),
        (F.col("metadata") if "metadata" in rows.columns
         else F.create_map().cast("map<string,string>")).alias("metadata"))


def delete_chunks(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """SRC18: chunks without the given ids (left anti join)."""
    return chunks.join(ids.select(key).distinct(), key, "left_anti")


def delete_document(chunks: DataFrame, doc_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """SRC19: all chunks of the given documents removed."""
    return chunks.join(doc_ids.select(key).distinct(), key, "left_anti")


def last_updates(updates: DataFrame, key: str = "chunk_id", version_col: str | None = None) -> DataFrame:
    """One update per id: that of the largest ``version_col``, if given; then
    the largest row, so reruns agree."""
    order = F.struct(*([version_col] if version_col else []), F.xxhash64(*updates.columns).alias("h"))
    return updates.groupBy(key).agg(F.max_by(F.struct(*updates.columns), order).alias("r")).select("r.*")


def upsert_chunks(chunks: DataFrame, updates: DataFrame, key: str = "chunk_id",
                  embed_col: str = "embedding", embedder=None,
                  version_col: str | None = None) -> DataFrame:
    """SRC20: replace rows by id, insert new ids; of several updates with one
    id the last counts (largest ``version_col``, if given; then the largest
    row, so reruns agree). An update without a vector is re-embedded with
    ``embedder(content_col) -> Column`` when given."""
    updates = last_updates(updates, key, version_col)
    if embedder is not None and embed_col in updates.columns:
        updates = updates.withColumn(embed_col, F.coalesce(F.col(embed_col), embedder(F.col("content"))))
    kept = chunks.join(updates.select(key), key, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def write_version(df: DataFrame, base: str, version: int) -> str:
    """Write a new table version directory; never the one being read."""
    path = f"{base.rstrip('/')}/v={int(version)}"
    df.write.mode("errorifexists").parquet(path)
    return path
