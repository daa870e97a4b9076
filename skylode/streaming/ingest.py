"""Extension: Structured Streaming into an index, and windowed counts of a stream with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import Index


def into_index(stream: DataFrame, index: Index, checkpoint: str, once: bool = True):
    """Each micro-batch becomes a segment and a version; readers see it when they reopen.

    The version keeps the batch's number under the checkpoint's name, so a batch that is tried again after its commit is
    not added twice. What the caller has pending in ``index`` stays pending.
    """

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            index.writer().add(df, source=checkpoint, batch=number).commit()

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts a window and key; rows later than ``late`` behind the newest are dropped by a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
