"""Topic intensity over a stream of turns, in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.operators.keywords import topical


def windowed_intensity(turns: DataFrame, strong: list[str], weak: list[str], time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, role, turns, topical_turns): works on a static frame or a stream;
    on a stream, turns later than ``late`` are dropped with their window."""
    flagged = turns.withWatermark(time, late).withColumn("hit", topical(F.col("text"), strong, weak).cast("int"))
    return flagged.groupBy(F.window(time, width), "role").agg(F.count("*").alias("turns"), F.sum("hit").alias("topical_turns"))
