"""Incremental loading as Structured Streaming: the checkpoint is the ledger of what was processed.

The model has no event-time windows of its own; `windowed_counts` is an addition for logs of events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.session import cut
from stratalog.sources.sinks import append_once


def new_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files that appear under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def load_available(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, checks: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> StreamingQuery:
    """Append everything that is there now, each batch once, and end. A later call goes on where this one ended.

    A batch that is replayed after a crash is written to the same place and so replaces itself; a batch that breaks a check
    is not written and stops the stream.
    """

    def write(batch: DataFrame, number: int) -> None:
        made = transform(batch)
        append_once(made, target, f"{checkpoint}/ledger", f"b{number:08d}", checks(made) if checks else None)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def keep_late(events: DataFrame, time: str, target: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Write the events that come more than `late` behind the newest of all earlier batches to a table: those that windowed_counts and sessions leave out.

    The newest time of each batch is kept beside the checkpoint, so a replayed batch is judged as before. Reads what is there, then ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch, "batch")
        newest = spark.read.parquet(f"{checkpoint}/newest/batch={number - 1}").first()["newest"] if number else None
        told = batch.agg(F.greatest(F.max(time), F.lit(newest).cast("timestamp")).alias("newest"))
        told.coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/newest/batch={number}")
        if newest is not None:
            append_once(batch.where(F.col(time) < F.lit(newest).cast("timestamp") - F.expr(f"interval {late}")), target, f"{checkpoint}/ledger", f"b{number:08d}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per key and window of event time; events later than `late` behind the newest are left out by the watermark; keep_late writes those down."""
    stream = events.withWatermark(time, late)
    counted = stream.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key that a pause of `gap` ends: starts, ends, keys, n. Works on streams and on tables."""
    stream = events.withWatermark(time, late) if events.isStreaming else events
    counted = stream.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), *keys, "n")
