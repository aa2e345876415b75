"""Document sources: binary files (SRC1), type detection (SRC2, SRC3),
decoding (SRC4), fetched pages (SRC7), upload and size checks (SRC8,
SRC9), structured request logs (SRC13).

Everything is a projection over ``binaryFile`` / parquet / JSON scans, so
Parquet and file-listing pruning apply and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File extension -> document type; unknown -> txt.
EXTENSION_TYPES = {
    ".pdf": "pdf", ".docx": "docx", ".txt": "txt", ".html": "html", ".htm": "html",
    ".md": "markdown", ".json": "json", ".csv": "csv", ".xlsx": "xlsx",
}
# Extensions accepted by the upload endpoint.
UPLOAD_ALLOWED = ["pdf", "docx", "txt", "html", "md", "json"]
MAX_FILE_MB = 50


def extension(path: Column) -> Column:
    """Lower-cased suffix including the dot ('' when none)."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def doc_type_ext(path: Column) -> Column:
    """SRC2: document type from the file suffix."""
    m = F.create_map(*[x for k, v in EXTENSION_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, extension(path)), F.lit("txt"))


def doc_type_mime(content_type: Column) -> Column:
    """SRC3: substring tests in the order pdf, html, json; else txt."""
    return (F.when(content_type.contains("pdf"), "pdf").when(content_type.contains("html"), "html")
            .when(content_type.contains("json"), "json").otherwise("txt"))


def decode_text(content: Column) -> Column:
    """SRC4: bytes -> UTF-8 text with invalid bytes dropped (invalid
    sequences become U+FFFD first, which is then removed)."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def scan_files(spark: SparkSession, fmt: str, path: str, glob: str | None = None, **options) -> DataFrame:
    """All files below a folder by one of Spark's file sources."""
    r = spark.read.format(fmt).options(**options)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.option("recursiveFileLookup", "true").load(path)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC1: files -> raw_documents (doc_id = path, title = file stem, size,
    modified time, document type, content bytes). Creation time has no
    source in the file listing and stays null."""
    df = scan_files(spark, "binaryFile", path, glob)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(
        F.col("path").alias("doc_id"), F.col("path").alias("file_path"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("title"),
        F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"),
        F.lit(None).cast("timestamp").alias("created_at"),
        doc_type_ext(F.col("path")).alias("document_type"), "content")


def raw_documents(documents: DataFrame) -> DataFrame:
    """The documents table as uploaded files: UTF-8 bytes and a path whose
    extension cycles through the supported types (every 50th is .exe)."""
    exts = F.array(*[F.lit(e) for e in ["pdf", "docx", "txt", "html", "htm", "md", "json", "csv"]])
    ext = F.when(F.col("doc_id") % 50 == 0, F.lit("exe")).otherwise(
        F.element_at(exts, (F.col("doc_id") % 8 + 1).cast("int")))
    return documents.select(
        "doc_id", F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit("."), ext)
        .alias("file_path"), F.encode("text", "UTF-8").alias("content"))


def upload_filter(files: DataFrame, name_col: str = "file_path",
                  allowed: list[str] = UPLOAD_ALLOWED) -> DataFrame:
    """SRC8: extension after the last '.', lower-cased; no dot -> txt;
    accepted when allowed, else rejected with a reason."""
    name = F.element_at(F.split(F.col(name_col), "/"), -1)
    ext = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("txt")
    ok = ext.isin(allowed)
    return (files.withColumn("extension", ext).withColumn("accepted", ok)
            .withColumn("reason", F.when(~ok, F.concat(F.lit("File type ."), ext,
                                                       F.lit(" not allowed")))))


def file_limits(files: DataFrame, size_col: str = "file_size", type_col: str = "extension",
                max_mb: int = MAX_FILE_MB, allowed: list[str] = UPLOAD_ALLOWED) -> DataFrame:
    """SRC9: size <= max MB and type in the allowed list."""
    return files.filter((F.col(size_col) <= max_mb * 1024 * 1024) & F.col(type_col).isin(allowed))


def title_from_url(url: Column) -> Column:
    """SRC6: last path segment, else the host."""
    path = F.regexp_replace(F.parse_url(url, F.lit("PATH")), r"^/+|/+$", "")
    return F.when(F.coalesce(path, F.lit("")) != "", F.element_at(F.split(path, "/"), -1)) \
        .otherwise(F.parse_url(url, F.lit("HOST")))


def url_documents(pages: DataFrame) -> DataFrame:
    """SRC7: fetched pages -> document rows (title, source_url, type, size)."""
    return pages.select(
        F.col("page_id").alias("doc_id"), title_from_url(F.col("url")).alias("title"),
        F.col("url").alias("source_url"), F.lit("html").alias("document_type"),
        F.octet_length("html").alias("file_size"), "html")


# ---------------------------------------------------------------- SRC13 ---
HTTP_LOG_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("ts", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("endpoint", T.StringType()),
    T.StructField("status_code", T.IntegerType()), T.StructField("duration_s", T.DoubleType()),
    T.StructField("client_ip", T.StringType()), T.StructField("user_agent", T.StringType()),
    T.StructField("api_key", T.StringType()), T.StructField("content_length", T.LongType()),
])


def parse_request_log(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """SRC13: structured JSON log lines -> typed http_log rows with a fixed
    schema; unparseable lines keep their text in ``_corrupt_record``."""
    parsed = F.from_json(F.col(line_col), HTTP_LOG_SCHEMA, {"mode": "PERMISSIVE"})
    out = lines.select(parsed.alias("r"), F.col(line_col).alias("_line"))
    ok = F.col("r").isNotNull() & F.col("r.request_id").isNotNull()
    return out.select("r.*", F.when(~ok, F.col("_line")).alias("_corrupt_record"))


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC13 from files: ``spark.read.json`` with the fixed schema."""
    schema = T.StructType([*HTTP_LOG_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
