"""Rollups of points to 15 minutes, one hour and one day, whole or incremental."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.functions.durations import RESOLUTION_SECONDS
from forescale.functions.times import floor_to, instant, shift

# How far a refresh reaches back and how close to now it goes, in seconds.
REFRESH_WINDOWS = {"15min": (86400, 900), "1h": (172800, 3600), "1d": (604800, 86400)}


def rollup(points: DataFrame, width_s: int) -> DataFrame:
    """Average, count, least and greatest value per series and bucket, straight from points."""
    return points.groupBy("series_id", floor_to(F.col("ts"), width_s).alias("ts")).agg(
        F.avg("value").alias("value"),
        F.count(F.lit(1)).alias("sample_count"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def rollup_all(points: DataFrame) -> DataFrame:
    """The three rollups in one table with a ``resolution`` column, from one scan.

    Sums and counts of the finest bucket merge exactly into the coarser ones, so the wide
    shuffle happens once; averages are never averaged. A day of a series has at most 96 of the
    finest buckets: they are brought together before they are unrolled to the coarser levels, so
    the rows of the levels are not shuffled.
    """
    finest, *coarser = sorted(RESOLUTION_SECONDS, key=RESOLUTION_SECONDS.get)
    fine = points.groupBy("series_id", floor_to(F.col("ts"), RESOLUTION_SECONDS[finest]).alias("_bucket")).agg(
        F.sum("value").alias("_sum"),
        F.count(F.lit(1)).alias("sample_count"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    days = fine.withColumn("_day", floor_to(F.col("_bucket"), RESOLUTION_SECONDS[coarser[-1]])).repartition("series_id", "_day")
    levels = F.array(*[
        F.struct(F.lit(name).alias("resolution"), floor_to(F.col("_bucket"), RESOLUTION_SECONDS[name]).alias("ts")) for name in coarser
    ])
    spread = days.select("series_id", "_day", F.explode(levels).alias("at"), "_sum", "sample_count", "min_value", "max_value")
    coarse = spread.groupBy("series_id", "_day", F.col("at.resolution").alias("resolution"), F.col("at.ts").alias("ts")).agg(
        F.sum("_sum").alias("_sum"),
        F.sum("sample_count").alias("sample_count"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
    )
    rows = fine.withColumnRenamed("_bucket", "ts").withColumn("resolution", F.lit(finest)).unionByName(coarse.drop("_day"))
    return rows.select(
        "resolution", "series_id", "ts", (F.col("_sum") / F.col("sample_count")).alias("value"), "sample_count", "min_value", "max_value"
    )


def refresh(old: DataFrame, points: DataFrame, resolution: str, as_of: datetime | str) -> DataFrame:
    """Recompute the whole buckets inside the refresh window and keep every other row."""
    width = RESOLUTION_SECONDS[resolution]
    back, lag = REFRESH_WINDOWS[resolution]
    start = floor_to(shift(instant(as_of), width - 1 - back), width)
    end = floor_to(shift(instant(as_of), -lag), width)
    inside = (F.col("ts") >= start) & (F.col("ts") < end)
    fresh = rollup(points.filter(inside), width)
    return old.filter(~inside).unionByName(fresh)


def context_range(context: DataFrame) -> DataFrame:
    """First and last instant and newest value per round and series."""
    return context.groupBy("round_id", "series_id").agg(
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.max_by("value", "ts").alias("latest_value")
    )


def context_stats(context: DataFrame) -> DataFrame:
    """Range, mean and sample deviation per round and series."""
    return context.groupBy("round_id", "series_id").agg(
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.avg("value").alias("value_avg"),
        F.stddev_samp("value").alias("value_std"),
    )
