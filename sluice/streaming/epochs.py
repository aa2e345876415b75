"""Streams with per-key state in versioned tables.

A per-key order on a stream needs what came before. Instead of one Python task
per key and micro-batch, a micro-batch (epoch) is one batch job: the state rows
of the epoch before and the epoch's rows go together through the batch operator,
which spreads a hot key over slots and segments, and the epoch's own rows come
out. What later epochs may need is written as the next version of the state.

    <base>/data/epoch=N          rows that came out
    <base>/state/<name>/epoch=N  state after epoch N
    <base>/meta/epoch=N          watermark, rows and late rows

An epoch that is tried again reads version N - 1 and overwrites its own
folders, so a restart gives the same answers. The watermark is the largest event
time so far less the delay; rows below it are late: they are dropped and counted.
State that the watermark has passed is not written again, and versions before
the last two are not read any more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

US = 1_000_000
UNITS = {"second": US, "minute": 60 * US, "hour": 3600 * US, "day": 86400 * US}

# (epoch's rows, state tables before, watermark in microseconds) -> (rows out, state tables)
Step = Callable[[DataFrame, dict[str, DataFrame], int], tuple[DataFrame, dict[str, DataFrame]]]


@dataclass
class EpochStream:
    """A streaming frame, the step of an epoch, and the watermark's delay."""

    rows: DataFrame
    step: Step
    delay: str
    ts: str = "ts"
    finish: Callable[[dict[str, DataFrame]], DataFrame] | None = None   # rows out of what is left at the end


def delay_us(text: str) -> int:
    """Microseconds of a delay such as "10 minutes"."""
    n, unit = text.split()
    return int(n) * UNITS[unit.rstrip("s")]


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def version(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """The table written by an epoch; None if there is none (an epoch begins
    after the one before has written all of its folders)."""
    try:
        return spark.read.parquet(f"{path}/epoch={epoch}")
    except AnalysisException:
        return None


def epoch_body(stream: EpochStream, base: str, names: list[str]):
    """The foreachBatch body."""
    wait = delay_us(stream.delay)

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        meta = version(spark, f"{base}/meta", epoch - 1)
        before = meta.first().watermark if meta is not None else None
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        at = micros(stream.ts)
        late = F.lit(False) if before is None else F.coalesce(at < before, F.lit(False))
        top, n, n_late = batch.agg(F.max(at), F.count("*"), F.count_if(late)).first()
        mark = max([x for x in (before, None if top is None else top - wait) if x is not None], default=0)
        state = {}
        for name in names:
            rows = version(spark, f"{base}/state/{name}", epoch - 1)
            if rows is not None:
                state[name] = rows
        out, state = stream.step(batch.filter(~late), state, mark)
        out.write.mode("overwrite").parquet(f"{base}/data/epoch={epoch}")
        for name, rows in state.items():
            rows.write.mode("overwrite").parquet(f"{base}/state/{name}/epoch={epoch}")
        spark.createDataFrame([(mark, n, n_late)], "watermark long, rows long, late long").write.mode(
            "overwrite").parquet(f"{base}/meta/epoch={epoch}")
        batch.unpersist()
    return run


def run_epochs(stream: EpochStream, base: str, names: list[str]) -> DataFrame:
    """Run over everything available; the rows of all epochs (and of
    ``finish``), without the epoch number."""
    spark = stream.rows.sparkSession
    query = (stream.rows.writeStream.option("checkpointLocation", f"{base}/_checkpoint")
             .trigger(availableNow=True).foreachBatch(epoch_body(stream, base, names)).start())
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/data").drop("epoch")
    if stream.finish is not None:
        last = spark.read.parquet(f"{base}/meta").agg(F.max("epoch")).first()[0]
        state = {n: version(spark, f"{base}/state/{n}", last) for n in names}
        out = out.unionByName(stream.finish({n: s for n, s in state.items() if s is not None}))
    return out
