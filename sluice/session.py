"""Session helpers: settings the library relies on, lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of the library assumes. Event times are UTC; AQE
# re-plans joins and coalesces shuffle partitions at runtime and splits
# skewed join partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "sluice",
                conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's base settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**BASE_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_sql_conf(spark)
    return spark


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_DEFAULT, ARROW_BATCH = 64 << 20, "16m"


def apply_sql_conf(spark: SparkSession) -> None:
    """Runtime SQL settings that are safe to set on an existing session, and
    the package shipped to the executors' Python workers. A batch of texts for
    Python has at most 16 MB (Spark's 64 MB are held several times over, in
    the JVM and in each worker) unless the user set a size."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(ARROW_BYTES, f"{ARROW_DEFAULT}b") == f"{ARROW_DEFAULT}b":
        spark.conf.set(ARROW_BYTES, ARROW_BATCH)
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Make ``sluice`` importable in executor Python workers (pandas UDFs,
    mapInPandas and state functions pickle references to its modules):
    zip the package once per SparkContext and hand it to ``addPyFile``,
    which distributes it to every executor."""
    import zipfile
    sc = spark.sparkContext
    if getattr(sc, "_sluice_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="sluice-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._sluice_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir). A
    session that runs in one process (master ``local``) may do without: it
    gets a scratch folder. On a cluster a missing setting is an error, since
    executors do not share local folders.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="sluice-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint) and truncates long
    plans built by repeated unions or iterations.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub path of the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), "tables", name)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
