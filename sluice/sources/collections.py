"""Chunk collections with deletes and upserts by merge on read (SRC18-SRC20).

    <path>/data/v=N/bucket=B    rows written by version N, never changed
    <path>/gone/v=N             ids (or document ids) that version N removes
    <path>/log/v=N              what version N was; written last, so a version
                                whose write fails is never read

A delete writes its ids, an upsert its ids and its rows; nothing is rewritten. A
row of version v is read unless a list of a later version names its id or its
document: the lists, one row per id, are joined to the rows (broadcast while
they are small). ``compact`` writes the rows that are left as one version and
forgets the lists before it; older versions stay readable until their folders
are removed. Rows are dealt to ``buckets`` folders by a hash of the id, so a
lookup by id reads one folder of each version.

One writer at a time. Defined results: an id that is not there is removed without
effect; of several updates with one id the last counts (largest ``version_col``,
then the largest row); rows without id are kept by every delete of ids.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.sinks import last_updates

BUCKETS = 16


class ChunkTable:
    """A collection at ``path``; ``key`` names a chunk, ``doc`` its document."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", doc: str = "doc_id",
                 buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.doc, self.buckets = spark, path.rstrip("/"), key, doc, buckets

    # ---- versions ----------------------------------------------------------
    def log(self) -> dict[int, str]:
        """Version -> what it was (append, upsert, delete, compact)."""
        try:
            rows = self.spark.read.schema("kind string, v int").parquet(f"{self.path}/log").collect()
        except AnalysisException:
            return {}
        return {r.v: r.kind for r in rows}

    def write(self, kind: str, rows: DataFrame | None = None, ids: DataFrame | None = None,
              docs: DataFrame | None = None) -> int:
        """Write the next version and return its number."""
        v = max(self.log(), default=0) + 1
        if rows is not None:
            bucket = self.bucket(F.col(self.key))
            (rows.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket")
             .parquet(f"{self.path}/data/v={v}"))
        for name, gone in ((self.key, ids), (self.doc, docs)):
            if gone is not None:
                gone.select(name).filter(F.col(name).isNotNull()).distinct().write.mode("overwrite").parquet(
                    f"{self.path}/gone/{name}/v={v}")
        self.spark.createDataFrame([(kind,)], "kind string").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/log/v={v}")
        return v

    def bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame) -> int:
        return self.write("append", rows)

    def delete(self, ids: DataFrame) -> int:
        """SRC18: without the given chunk ids."""
        return self.write("delete", ids=ids)

    def delete_documents(self, docs: DataFrame) -> int:
        """SRC19: without the chunks of the given documents."""
        return self.write("delete", docs=docs)

    def upsert(self, updates: DataFrame, version_col: str | None = None) -> int:
        """SRC20: rows replaced by id, new ids added."""
        updates = last_updates(updates, self.key, version_col)
        return self.write("upsert", rows=updates, ids=updates)

    def compact(self) -> int:
        """The rows of the newest version as one version without lists."""
        return self.write("compact", rows=self.read())

    # ---- reading -------------------------------------------------------------
    def read(self, version: int | None = None, key: str | None = None) -> DataFrame:
        """The rows at a version (default: the newest); with ``key`` only the
        chunk of that id, from its bucket."""
        log = {v: k for v, k in self.log().items() if version is None or v <= version}
        base = max((v for v, k in log.items() if k == "compact"), default=0)
        written = [v for v, k in log.items() if k != "delete" and v >= base]
        if not written:
            raise ValueError(f"no rows at {self.path}")
        rows = (self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/data")
                .parquet(*[f"{self.path}/data/v={v}" for v in sorted(written)]))
        if key is not None:
            rows = rows.filter((F.col("bucket") == self.bucket(F.lit(key))) & (F.col(self.key) == key))
        for name, kinds in ((self.key, ("delete", "upsert")), (self.doc, ("delete",))):
            gone = self.gone(name, [v for v, k in log.items() if k in kinds and v > base])
            if gone is not None:
                rows = rows.join(gone, name, "left").filter(F.col("_gone").isNull() | (F.col("v") >= F.col("_gone")))
                rows = rows.drop("_gone")
        return rows.drop("v", "bucket")

    def gone(self, name: str, versions: list[int]) -> DataFrame | None:
        """(<name>, _gone): the newest version that removes each id."""
        found = []
        for v in sorted(versions):
            try:
                found.append(self.spark.read.parquet(f"{self.path}/gone/{name}/v={v}").withColumn("_v", F.lit(v)))
            except AnalysisException:       # a version that removes by the other name
                continue
        if not found:
            return None
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.groupBy(name).agg(F.max("_v").alias("_gone"))
