"""Arriving revisions as a stream (an extra: the batch operators do the same without it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_revisions(stream: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """A stream of revisions with each revision once, as long as its copies come within ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows per key and tumbling window; a window comes out when the watermark has passed it."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("window_start"), key, "rows")


def refresh_each(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``refresh`` on every micro-batch; with the batch id it can make its writes idempotent."""
    return stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
