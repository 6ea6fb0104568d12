"""Streaming: the latest pending patch of each control, and reveals as events arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_patches(messages: DataFrame) -> DataFrame:
    """(control, key, value, persist, seq) of messages (control, seq, patch map, persist): for each key the last value wins; persist
    holds once asked for; seq is the control's last."""
    last = messages.groupBy("control").agg(F.max("seq").alias("seq"), F.bool_or(F.coalesce("persist", F.lit(False))).alias("persist"))
    entries = messages.select("control", "seq", F.explode("patch").alias("key", "value"))
    merged = entries.groupBy("control", "key").agg(F.max_by("value", "seq").alias("value"))
    return merged.join(last, "control").select("control", "key", "value", "persist", "seq")


def apply_latest(messages: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a stream that hands each micro-batch's merged patches to update; what a batch holds is superseded within it."""
    return messages.writeStream.foreachBatch(lambda batch, n: update(latest_patches(batch), n)).option("checkpointLocation", checkpoint).start()


def counted_windows(events: DataFrame, width: str, late: str) -> DataFrame:
    """(begin, end, n) of events (ts) by time window; events later than late are dropped. An extension."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")
