"""Tumbling and sliding aggregates (STR-03/04, AGG-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measures(value: str, total: str | None = None, time: str | None = None) -> list[Column]:
    """AGG-01: count, mean, least, most and population deviation of a value; sum of another; time bounds."""
    out = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_pop(value).alias("std")]
    if total:
        out.append(F.sum(total).alias("total"))
    if time:
        out += [F.min(time).alias("first_time"), F.max(time).alias("last_time")]
    return out


def windowed(df: DataFrame, time: str, size: str, slide: str | None, keys: list[str], aggregates: list[Column], watermark: str = "10 minutes") -> DataFrame:
    """Aggregates by window and keys with window_start and window_end; on a stream behind a watermark."""
    if df.isStreaming:
        df = df.withWatermark(time, watermark)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = df.groupBy(window.alias("window"), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(c for c in grouped.columns if c != "window"))
