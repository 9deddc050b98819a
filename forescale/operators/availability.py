"""How fresh and how complete series are, and how far back to fetch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forescale.functions.durations import RESOLUTION_SECONDS
from forescale.functions.times import instant, shift

# Fixed values, in seconds by native frequency: the age shown as expected, and the age still
# counted as recent. Hourly series show six hours but are given twelve.
SHOWN_AGE = {3600: 21600, 86400: 172800, 900: 21600}
RECENT_AGE = {3600: 43200, 86400: 172800, 900: 21600}
OTHER_AGE = 172800

MIN_CONTEXT_POINTS = 1000
DEFAULT_LOOKBACK_S = 86400
MAX_LOOKBACK_S = 30 * 86400


def _age(frequency_s: Column, ages: dict[int, int]) -> Column:
    picked = F.lit(OTHER_AGE)
    for frequency, age in ages.items():
        picked = F.when(frequency_s == frequency, F.lit(age)).otherwise(picked)
    return picked


def data_availability(
    series: DataFrame, category: DataFrame, points: DataFrame, as_of: datetime | str,
    shown: dict[int, int] = SHOWN_AGE, recent: dict[int, int] = RECENT_AGE,
) -> DataFrame:
    """Newest point of every series and whether it is recent enough for its frequency."""
    now = instant(as_of)
    latest = points.filter(F.col("ts") <= now).groupBy("series_id").agg(F.max("ts").alias("last_data_ts"))
    dims = category.select(F.col("id").alias("category_id"), "domain", "subdomain", "category", "subcategory")
    frequency = F.col("frequency_s")
    fresh = F.col("last_data_ts") >= shift(now, -_age(frequency, recent))
    return (
        series.select("series_id", "name", "frequency_s", "unique_id", "category_id")
        .join(dims, "category_id", "left")
        .join(latest, "series_id", "left")
        .select(
            "series_id", "name", "frequency_s", "unique_id", "domain", "subdomain", "category", "subcategory",
            "last_data_ts", shift(now, -_age(frequency, shown)).alias("expected_threshold"),
            F.coalesce(fresh, F.lit(False)).alias("has_recent_data"),
        )
    )


def completeness(
    wanted: DataFrame, points: DataFrame, start: datetime | str, end: datetime | str,
    frequency_s: int | None, threshold: float = 0.5,
) -> DataFrame:
    """Share of the expected points per wanted series; without a frequency, existence only."""
    low, high = instant(start), instant(end)
    counts = points.filter(F.col("ts").between(low, high)).groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    joined = wanted.select("series_id").distinct().join(counts, "series_id", "left")
    if frequency_s is None:
        return joined.select("series_id", n.alias("n_points"), (n > 0).alias("is_complete"))
    span = (F.unix_micros(high) - F.unix_micros(low)) / 1_000_000
    expected = (F.floor(span / frequency_s) + 1).cast("long")
    ratio = n / expected
    return joined.select(
        "series_id", n.alias("n_points"), expected.alias("expected_points"), ratio.alias("ratio"),
        ((n > 0) & (ratio >= threshold)).alias("is_complete"),
    )


def all_complete(checked: DataFrame) -> DataFrame:
    return checked.agg(F.coalesce(F.bool_and("is_complete"), F.lit(True)).alias("all_complete"))


def usable_at(series: DataFrame, resolution: str) -> DataFrame:
    """Series whose native frequency is at least as fine as the resolution."""
    width = RESOLUTION_SECONDS.get(resolution)
    if width is None:
        return series.filter(F.lit(False))
    return series.filter(F.col("frequency_s").isNotNull() & (F.col("frequency_s") <= width))


def backfill_plan(catalogue: DataFrame, points: DataFrame, as_of: datetime | str) -> DataFrame:
    """Lookback per series: enough intervals to reach the least context, else one day.

    ``catalogue`` has unique_id, series_id (NULL when not stored yet) and interval_s.
    """
    counts = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    short = F.col("series_id").isNotNull() & (n < MIN_CONTEXT_POINTS)
    wide = F.least((MIN_CONTEXT_POINTS - n) * F.col("interval_s"), F.lit(MAX_LOOKBACK_S))
    lookback = F.when(short, wide).otherwise(F.lit(DEFAULT_LOOKBACK_S)).cast("long")
    return catalogue.join(counts, "series_id", "left").select(
        "unique_id", "series_id", n.alias("n_points"), lookback.alias("lookback_s"),
        shift(instant(as_of), -lookback).alias("start_ts"),
    )


def backfill_plan_grouped(catalogue: DataFrame, points: DataFrame, as_of: datetime | str) -> DataFrame:
    """One lookback per ``group_id``: the greatest need of its series times the finest interval."""
    counts = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    need = F.when(F.col("series_id").isNull(), F.lit(MIN_CONTEXT_POINTS)).otherwise(
        F.greatest(F.lit(MIN_CONTEXT_POINTS) - F.coalesce(F.col("_n"), F.lit(0)), F.lit(0))
    )
    grouped = catalogue.join(counts, "series_id", "left").groupBy("group_id").agg(
        F.max(need).cast("long").alias("max_needed"), F.min("interval_s").cast("long").alias("min_interval_s")
    )
    wide = F.least(F.col("max_needed") * F.col("min_interval_s"), F.lit(MAX_LOOKBACK_S))
    lookback = F.when(F.col("max_needed") > 0, wide).otherwise(F.lit(DEFAULT_LOOKBACK_S)).cast("long")
    return grouped.withColumn("lookback_s", lookback).withColumn("start_ts", shift(instant(as_of), -lookback))
