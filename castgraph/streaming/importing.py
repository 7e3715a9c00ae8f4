"""Incremental imports as streams: batches of credits folded in per person, and event-time windows. Extensions beyond batch views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from castgraph.operators import merge


def import_credits(stream: DataFrame, read_people, write_people) -> DataStreamWriter:
    """A stream of (id, seq, credit) folded into people batch by batch. Folding a batch again changes nothing (sources with a URL or
    attester are then already cited), so a batch replayed after a failure is harmless. `write_people(df, batch)` must replace atomically."""

    def fold(batch: DataFrame, number: int) -> None:
        write_people(merge.upsert_batch(read_people(), batch), number)

    return stream.writeStream.foreachBatch(fold)


def windowed_values(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Count and sum per type and tumbling window; events later than the watermark drop out."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after a gap."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
