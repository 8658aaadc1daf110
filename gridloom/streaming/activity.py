"""Measured activity: distinct devices per cell and quarter of an hour, as a stream or a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(events: DataFrame, length: str = "15 minutes", late: str = "30 minutes", exact: bool = False, scope: str | None = None) -> DataFrame:
    """(window_start, cell_id, scope?, devices) of events (ts, cell_id, scope?, user_id).

    On a stream, rows later than ``late`` behind the newest are dropped by the watermark and a window
    is emitted once it is past it. ``exact``: count instead of estimating (batch only).
    """
    rows = events.where(F.col("cell_id").isNotNull() & F.col("ts").isNotNull())
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    devices = F.count_distinct("user_id") if exact else F.approx_count_distinct("user_id", 0.01)
    keys = ["cell_id", *([scope] if scope else [])]
    return rows.groupBy(F.window("ts", length).alias("w"), *keys).agg(devices.alias("devices")).select(F.col("w.start").alias("window_start"), *keys, "devices")
