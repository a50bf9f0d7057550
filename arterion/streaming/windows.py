"""Event-time windows over frames, the same for batch and for streams: what a watermark has passed is final."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hop_means(frames: DataFrame, length: str = "30 seconds", hop: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(session_id, start, end, frames, mean, missing): windows of ``frames`` (session_id, ts, value, dropped)."""
    rows = frames.withWatermark("ts", late) if frames.isStreaming else frames
    out = rows.groupBy("session_id", F.window("ts", length, hop)).agg(F.count(F.lit(1)).alias("frames"), F.avg(F.when(~F.col("dropped"), F.col("value"))).alias("mean"), F.avg(F.col("dropped").cast("double")).alias("missing"))
    return out.select("session_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "frames", "mean", "missing")


def gap_sessions(frames: DataFrame, gap: str = "30 minutes", late: str = "10 seconds") -> DataFrame:
    """(session_id, start, last, frames): runs of frames no two of which are ``gap`` apart."""
    rows = frames.withWatermark("ts", late) if frames.isStreaming else frames
    out = rows.groupBy("session_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("frames"), F.max("ts").alias("last"))
    return out.select("session_id", F.col("session_window.start").alias("start"), "last", "frames")
