"""Event-time streams over tables and logs (an extension: the operators work on streams and on batches alike)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` for each window and key; ``late`` bounds the state of a stream by a watermark."""
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    out = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def deduplicated(df: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """A store's log as it grows."""
    from ..sources.snapshots import LOGGED, mutations

    return mutations(spark.readStream.schema(LOGGED).json(f"{path}/versions"))
