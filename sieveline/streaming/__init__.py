"""The same columns over streams: filters are stateless; savings and log counts are windowed with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import filters


def filtered(stream: DataFrame, defs: list[filters.FilterDef], command: str = "command", raw: str = "raw") -> DataFrame:
    return filters.apply_routed(stream, command, raw, defs)


def windowed_gain(stream: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Savings by event-time window; rows later than ``late`` are dropped and closed windows leave the state."""
    on = ~F.col("passthrough")
    s = stream.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count(F.lit(1)).alias("commands"), F.sum(F.when(on, F.col("raw_tokens"))).alias("raw_tokens"), F.sum(F.when(on, F.col("out_tokens"))).alias("out_tokens"))
    return s.select(F.col("window.start").alias("start"), "commands", "raw_tokens", "out_tokens", (F.col("raw_tokens") - F.col("out_tokens")).alias("tokens_saved"))


def windowed_log_counts(stream: DataFrame, line: str, ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    s = stream.withColumn("severity", T.log_severity(line)).where("severity IS NOT NULL").withColumn("key", T.normalize_log(line))
    return s.withWatermark(ts, late).groupBy(F.window(ts, window), "severity", "key").agg(F.count(F.lit(1)).alias("n"))


def first_seen(stream: DataFrame, line: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each normalised line once within the watermark."""
    return stream.withColumn("key", T.normalize_log(line)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["key"])
