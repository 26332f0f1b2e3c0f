"""Passes as micro-batches: staged input files are read one batch a pass, and sinks are written once a batch.

A batch may run again after a failure, so a sink writes to a folder named by its batch, replacing what a failed
try left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaweave.sources.shared import shared_dir


def passes(log: DataFrame, column: str, groups: int) -> tuple[str, str]:
    """Write a log as one folder of files per group of passes, in order; (glob, schema)."""
    spark = log.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    low, high = log.agg(F.min(column), F.max(column)).first()
    low, high = low or 0, high or 0
    size = (high - low) // groups + 1
    for g in range(groups):
        part = log.where(F.col(column).between(low + g * size, low + (g + 1) * size - 1))
        part.coalesce(1).write.mode("append").parquet(at)
    return at, log.schema


def stream(spark: SparkSession, at: str, schema, per_batch: int = 1) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(at)


class Passes:
    """Runs a streaming frame to its end, one pass a micro-batch; ``each`` gets (batch, pass number). With a folder ``at``
    that an earlier run used, it goes on where that run ended, with its state."""

    def __init__(self, frame: DataFrame, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", at: str | None = None):
        self.frame, self.each, self.mode = frame, each, mode
        spark = frame.sparkSession
        self.at = at or f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
        self.ran: list[int] = []

    def _write(self, batch: DataFrame, number: int) -> None:
        if self.each is not None:
            self.each(batch, number)
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.at}/rows/batch={number:06d}")
        self.ran.append(number)

    def run(self) -> DataFrame:
        """All rows that the sink got; with mode "update" the rows of later batches stand beside earlier ones, told
        apart by ``_batch``."""
        spark = self.frame.sparkSession
        query = self.frame.writeStream.foreachBatch(self._write).outputMode(self.mode).option("checkpointLocation", f"{self.at}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
        schema = self.frame.withColumn("_batch", F.lit(0)).schema
        if not self.ran:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"{self.at}/rows/batch={n:06d}" for n in self.ran))


class Maintained:
    """A fold kept up over passes by signed changes: each pass adds what its batch brings to ``start``, the value that a
    run before it ended with."""

    def __init__(self, start: int = 0):
        self.start, self.history = start, []

    @property
    def total(self) -> int:
        return self.history[-1][1] if self.history else self.start

    def take(self, number: int, delta: int) -> None:
        """A pass that runs again replaces its own part."""
        self.history = [h for h in self.history if h[0] < number]
        self.history.append((number, self.total + delta))


def windowed(events: DataFrame, late: str, size: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Event-time windows with a watermark; times without a zone are cast, as watermarks ask for it."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
