"""Micro-batch forms: annotating texts as they come, keeping the last row per key, cases in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shirabe.operators.annotate import annotate


def annotate_stream(texts: DataFrame, entries: DataFrame, key: str, text: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Annotate every micro-batch of a streaming table and hand it to ``sink(table, batch number)``.

    The dictionary is a static table.  A batch that is run again has the same number, so a sink that
    writes by number is exactly-once.
    """

    def batch(df: DataFrame, n: int) -> None:
        sink(annotate(df, entries, key, text, **options), n)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, ts: str, by: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per window and key; rows later than ``late`` are dropped.  Works on batch and streaming tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def last_by_key(log: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """The last value per key of an append log, as a streaming aggregate (update mode) or a batch one."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))
