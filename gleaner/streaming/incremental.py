"""Incremental runs: new question files are processed as they arrive, each once.

The checkpoint takes the place of scanning finished ids; an output id is still written only once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.sources import sinks


def run_incremental(spark: SparkSession, source: str, schema: str, output: str, checkpoint: str, key: str, process: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """A query over JSON lines in ``source`` that appends processed rows to ``output`` and ends when
    all present files are done."""

    def one(batch: DataFrame, _: int) -> None:
        sinks.run_resumable(batch.dropDuplicates([key]), output, key, process)

    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by time window and kind; rows later than ``late`` are too late on a stream."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), kind, "n", "total")
