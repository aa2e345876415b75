"""SHA-256 of whole files of any size (SRC1).

A digest is a chain over a file's bytes in order, but no task has to read the
whole file: the bytes are read in splits by many tasks (Spark's text source,
so from every store that Spark reads), written once in pieces, and hashed part
by part. A round hashes one part of every long file, one task a file, and
hands the state of the digest to the next round.
"""

from __future__ import annotations

import ctypes
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.session import cut_lineage, scratch_path
from sluice.sources.files import scan_files

# Files of at most this many bytes are hashed whole; longer ones in such parts.
PART_BYTES = 128 << 20
PIECE_BYTES = 256 << 10
# Files with a longer stretch without a newline byte are hashed whole: the text
# source passes over such a line, so the bytes read fall short of the file.
LINE_BYTES = 32 << 20
# Names that the text source would decompress; their files are hashed whole.
CODEC_NAMES = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"
BOM = b"\xef\xbb\xbf"
STATE_BYTES = 112  # SHA256_CTX of openssl/sha.h
PIECES = "uri string, start long, seq long, n long, body binary"
STATES = "file_no int, file_path string, left long, bom boolean, state binary, sha256 string"


def openssl_sha256():
    """init, update and final of the OpenSSL that ``hashlib`` is built on, or
    None without it. ``hashlib`` keeps its state to itself; OpenSSL's is a
    plain struct that another task can go on with."""
    try:
        import _hashlib
        lib = ctypes.CDLL(getattr(_hashlib, "__file__", None))
        calls = lib.SHA256_Init, lib.SHA256_Update, lib.SHA256_Final
    except (ImportError, OSError, AttributeError):
        return None
    for call, args in zip(calls, ([ctypes.c_void_p], [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t],
                                  [ctypes.c_char_p, ctypes.c_void_p])):
        call.argtypes = args
    return calls


def _join_lines(batches):
    """Lines of a split -> its bytes in pieces, each line with its newline."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    seq = 0
    for b in batches:
        if not b.num_rows:
            continue
        value, uri, start = b.column(0), b.column(1), b.column(2).to_numpy()
        code = uri.dictionary_encode().indices.to_numpy()
        turns = np.flatnonzero((np.diff(code) != 0) | (np.diff(start) != 0)) + 1
        for i, j in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows]):
            run = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), value.slice(i, j - i))
            body = pc.binary_join(run, b"\n")[0].as_py() + b"\n"
            cuts = [body[k:k + PIECE_BYTES] for k in range(0, len(body), PIECE_BYTES)]
            n = len(cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri[i].as_py()] * n, pa.string()), pa.array([int(start[i])] * n, pa.int64()),
                 pa.array(range(seq, seq + n), pa.int64()), pa.array([len(c) for c in cuts], pa.int64()),
                 pa.array(cuts, pa.binary())], names=["uri", "start", "seq", "n", "body"])
            seq += n


def _hash_part(batches):
    """A file's state, then the bytes of one part in order -> its new state."""
    import pyarrow as pa
    init, update, final = openssl_sha256()

    def row(f, ctx):
        if not f["left"] and f["sha256"] is None:
            out = ctypes.create_string_buffer(32)
            final(out, ctx)
            f["sha256"] = out.raw.hex()
        return pa.RecordBatch.from_arrays(
            [pa.array([f["file_no"]], pa.int32()), pa.array([f["file_path"]], pa.string()), pa.array([f["left"]], pa.int64()),
             pa.array([f["bom"]], pa.bool_()), pa.array([ctx.raw], pa.binary()), pa.array([f["sha256"]], pa.string())],
            names=["file_no", "file_path", "left", "bom", "state", "sha256"])

    f = ctx = None
    for b in batches:
        for r in b.to_pylist():
            if r["start"] < 0:
                if f:
                    yield row(f, ctx)
                f, ctx = r, ctypes.create_string_buffer(r["state"] or b"", STATE_BYTES)
                if r["state"] is None:
                    init(ctx)
                    if f["bom"]:
                        update(ctx, BOM, len(BOM))
                        f["left"] -= len(BOM)
            else:
                body = r["body"][:f["left"]]
                update(ctx, body, len(body))
                f["left"] -= len(body)
    if f:
        yield row(f, ctx)


def _pieces(spark: SparkSession, path: str, glob: str | None, ids: DataFrame, part_bytes: int) -> DataFrame:
    """The bytes of the long files, read in splits and written once."""
    options = {"lineSep": "\n", "mapreduce.input.linerecordreader.line.maxlength": LINE_BYTES}
    lines = scan_files(spark, "text", path, glob, **options).filter(_long(part_bytes)).select(
        F.col("value").cast("binary"), "_metadata.file_path", "_metadata.file_block_start")
    rows = lines.mapInArrow(_join_lines, PIECES).join(F.broadcast(ids.select("uri", "file_no")), "uri").select(
        "file_no", F.floor(F.col("start") / part_bytes).alias("part"), "start", "seq", "n", "body")
    to = scratch_path(spark, f"file-pieces-{uuid.uuid4().hex}")
    # A reader holds a row group: small ones, though a piece is a long value.
    rows.write.option("parquet.block.size", 16 << 20).parquet(to)
    return spark.read.schema(rows.schema).parquet(to)


def _long(part_bytes: int):
    """Files hashed in parts; a filter on the listing, no byte is read for it."""
    return (F.col("_metadata.file_size") > part_bytes) & ~F.col("_metadata.file_name").rlike(CODEC_NAMES)


def _long_digests(spark: SparkSession, path: str, glob: str | None, part_bytes: int) -> tuple[DataFrame | None, list[str]]:
    """file_path, sha256 of the long files (None if there is none), and the
    names of those among them that the text source did not read whole."""
    found = scan_files(spark, "binaryFile", path, glob).filter(_long(part_bytes)).select(
        F.col("path").alias("file_path"), "length", F.col("_metadata.file_path").alias("uri"))
    if found.isEmpty():
        return None, []
    ids = found.withColumn("file_no", F.row_number().over(Window.orderBy("uri")) - 1)
    pieces = _pieces(spark, path, glob, ids, part_bytes)
    # Every line has got a newline (the last of a file may have none), and the
    # text source leaves a byte order mark out; other files were not read whole.
    extra = F.coalesce("total", F.lit(0)) - F.col("length")
    sizes = cut_lineage(ids.join(pieces.groupBy("file_no").agg(F.sum("n").alias("total")), "file_no", "left").select(
        "file_no", "file_path", "uri", "length", extra.isin(0, 1, -2, -3).alias("read"), (extra < 0).alias("bom")))
    torn = [r.uri for r in sizes.filter(~F.col("read")).select("uri").collect()]
    state = sizes.filter("read").select(
        "file_no", "file_path", F.col("length").alias("left"), "bom", F.lit(None).cast("binary").alias("state"),
        F.lit(None).cast("string").alias("sha256"))
    last, longest = state.agg(F.max("file_no"), F.max("left")).first()
    for part in range(-(-(longest or 0) // part_bytes)):
        rows = state.withColumns({"start": F.lit(-1).cast("long"), "seq": F.lit(-1).cast("long")}).unionByName(
            pieces.filter(F.col("part") == part).join(F.broadcast(state.select("file_no")), "file_no", "left_semi")
            .select("file_no", "start", "seq", "body"), allowMissingColumns=True)
        state = cut_lineage(rows.repartitionById(last + 1, "file_no").sortWithinPartitions("file_no", "start", "seq")
                            .mapInArrow(_hash_part, STATES))
    return state.select("file_path", "sha256"), torn


def content_digest(files: DataFrame, path: str, glob: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """``read_files(spark, path, glob)`` with length and SHA-256 of the content
    in its place (``bytes``, ``sha256``). No task reads more of a file than a
    part and a split. Names of CODEC_NAMES, files with longer lines than
    LINE_BYTES, and all where ``hashlib`` is not built on OpenSSL, are hashed
    as one value."""
    spark = files.sparkSession
    digests, torn = _long_digests(spark, path, glob, part_bytes) if openssl_sha256() else (None, [])
    by_part = F.lit(False) if digests is None else _long(part_bytes) & ~F.col("_metadata.file_path").isin(torn)
    whole = files.filter(~by_part).withColumns(
        {"bytes": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256)}).drop("content")
    if digests is None:
        return whole
    rest = files.filter(by_part).withColumn("bytes", F.col("file_size")).drop("content")
    return whole.unionByName(rest.join(F.broadcast(digests), "file_path", "left"))
