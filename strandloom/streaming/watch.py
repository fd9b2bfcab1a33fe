"""Incremental processing of arriving files and event-time windows with Structured Streaming.

Progress lives in the stream's checkpoint: a restarted stream goes on
where it stopped, inputs are read once and are never deleted. Batches are
written under their number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Rows of the files that arrive under ``path``."""
    r = spark.readStream.schema(schema).format(format)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(path)


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now, each batch transformed and written idempotently, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Of the updates of a key the one of the last batch."""
    t = spark.read.parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return t.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch")


def windowed(events: DataFrame, ts: str, size: str, late: str, groups: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window; events later than ``late`` behind the latest are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), *groups).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *groups, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
