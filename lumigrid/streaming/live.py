"""Live acquisition: intensity folds of a growing recording with Structured Streaming.

An extension; batch tables are the main way in. Frames arrive as (recording, g, ts, pix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_means(frames: DataFrame) -> DataFrame:
    """Frames to their mean intensity m, stateless."""
    total = F.aggregate("pix", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return frames.select("recording", "g", "ts", (total / F.size("pix")).alias("m"))


def rolling_fold(means: DataFrame, cycle: int, window: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """Mean, deviation and count by phase in each event-time window; later frames than ``delay`` are dropped, and so state stays bounded."""
    phase = F.pmod("g", F.lit(cycle)).cast("long")
    folded = means.withWatermark("ts", delay).groupBy("recording", F.window("ts", window), phase.alias("phase"))
    return folded.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count(F.lit(1)).alias("n")).select("recording", F.col("window.start").alias("start"), "phase", "mean", "std", "n")


def gaps(means: DataFrame, silence: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Stretches of acquisition between silences, per recording: session windows with their frame counts."""
    sessions = means.withWatermark("ts", delay).groupBy("recording", F.session_window("ts", silence))
    return sessions.agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("first"), F.max("g").alias("last")).select("recording", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "first", "last")
