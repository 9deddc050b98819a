"""Rollups, scans, catalogue, availability, gap filling and resampling."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.functions.times import in_dates
from forescale.operators import availability, imputation, ordered, resample, rollup
from forescale.operators.rounds import filter_series
from forescale.operators.upsert import apply_retention
from forescale.plans.queries.registry import query, rounded
from forescale.plans.world import AS_OF, World
from forescale.sources import scans

START, END = datetime(2024, 1, 1), datetime(2024, 1, 31)


def _rollup(w: World, width: int) -> DataFrame:
    return rounded(rollup.rollup(w.points, width), "value")


@query
def rollup_15min(w: World) -> DataFrame:
    return _rollup(w, 900)


@query
def rollup_1h(w: World) -> DataFrame:
    return _rollup(w, 3600)


@query
def rollup_1d(w: World) -> DataFrame:
    return _rollup(w, 86400)


@query
def rollup_all(w: World) -> DataFrame:
    return rounded(rollup.rollup_all(w.points), "value")


@query
def rollup_refresh(w: World) -> DataFrame:
    """Hourly rollup built from values that were 1000 too high, refreshed with the right ones."""
    old = rollup.rollup(w.points.withColumn("value", F.col("value") + 1000), 3600)
    return rounded(rollup.refresh(old, w.points, "1h", AS_OF), "value", "min_value", "max_value")


@query
def range_scan(w: World) -> DataFrame:
    return scans.scan_points(w.points, datetime(2024, 1, 5), datetime(2024, 1, 20)).select("series_id", "ts", "value")


@query
def scan_by_resolution(w: World) -> DataFrame:
    return rounded(scans.scan_by_resolution(w.points, w.rollups, "15min", datetime(2024, 1, 5), datetime(2024, 1, 20)), "value")


@query
def scan_unknown_resolution(w: World) -> DataFrame:
    """Drill-downs read raw points when the resolution is unknown."""
    return scans.scan_by_resolution(w.points, w.rollups, "7min", START, AS_OF, unknown="raw")


@query
def series_data_for_rounds(w: World) -> DataFrame:
    return rounded(scans.series_data_for_rounds(w.rounds, w.pseudo, w.rollups, datetime(2024, 1, 12), datetime(2024, 1, 16)), "value")


@query
def get_data_default_window(w: World) -> DataFrame:
    """Last seven days of every catalogue series by unique id."""
    return rounded(scans.get_data(w.series, w.points, w.rollups, None, AS_OF, resolution="1h"), "value")


@query
def point_summary(w: World) -> DataFrame:
    return scans.point_summary(w.points)


@query
def latest_per_series(w: World) -> DataFrame:
    """Newest value of every series."""
    return w.points.groupBy("series_id").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


@query
def last_n_points(w: World) -> DataFrame:
    return scans.last_points(w.points, 100).select("series_id", "ts", "value")


@query
def last_n_points_before(w: World) -> DataFrame:
    return scans.last_points(w.points, 40, AS_OF).select("series_id", "ts", "value")


@query
def numbered_points(w: World) -> DataFrame:
    return ordered.number_rows(w.points, ["series_id"], "ts").select("series_id", "ts", "pos")


@query
def value_changes(w: World) -> DataFrame:
    """Events of each user whose type differs from the one before."""
    return ordered.changes_only(w.events.select("user_id", "ts", "event_type"), ["user_id"], "ts", "event_type")


@query
def value_carry(w: World) -> DataFrame:
    """Newest known value per user, error events counting as unknown."""
    known = w.events.select("user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return ordered.forward_fill(known, ["user_id"], "ts", "value")


@query
def as_of_values(w: World) -> DataFrame:
    """Every event with its user's newest purchase at that moment."""
    left = w.events.select("event_id", "user_id", "ts")
    right = w.events.filter(F.col("event_type") == "purchase").select("user_id", F.col("ts").alias("bought_ts"), F.col("value").alias("bought"))
    return ordered.as_of_join(left, right, ["user_id"], "ts", "bought_ts", ["bought_ts", "bought"])


@query
def data_availability(w: World) -> DataFrame:
    return availability.data_availability(w.series, w.category, w.points, AS_OF)


@query
def completeness(w: World) -> DataFrame:
    checked = availability.completeness(w.series, w.points, datetime(2024, 1, 8), datetime(2024, 1, 15), 86400, 0.9)
    return rounded(checked, "ratio")


@query
def completeness_existence(w: World) -> DataFrame:
    return availability.completeness(w.series, w.points, datetime(2024, 1, 8), datetime(2024, 1, 8, 6), None)


@query
def completeness_all(w: World) -> DataFrame:
    return availability.all_complete(availability.completeness(w.series, w.points, START, END, 86400))


@query
def usable_series(w: World) -> DataFrame:
    return availability.usable_at(w.series, "1h").select("series_id", "frequency_s")


@query
def backfill_plan(w: World) -> DataFrame:
    catalogue = w.series.select("unique_id", F.when(F.col("series_id") % 9 != 4, F.col("series_id")).alias("series_id"), F.col("frequency_s").alias("interval_s"))
    return availability.backfill_plan(catalogue, w.points, AS_OF)


@query
def backfill_plan_grouped(w: World) -> DataFrame:
    catalogue = w.series.select(
        F.col("category_id").alias("group_id"), F.when(F.col("series_id") % 9 != 4, F.col("series_id")).alias("series_id"),
        F.col("frequency_s").alias("interval_s"),
    )
    return availability.backfill_plan_grouped(catalogue, w.points, AS_OF)


@query
def impute_gaps(w: World) -> DataFrame:
    return rounded(imputation.impute_gaps(w.point_frequency), "value")


@query
def imputation_counts(w: World) -> DataFrame:
    return imputation.imputation_counts(imputation.impute_gaps(w.point_frequency))


@query
def imputed_operational(w: World) -> DataFrame:
    """Rows for the current table of hourly buckets filled at one hour."""
    hourly = w.rollups.filter(F.col("resolution") == "1h").withColumn("frequency_s", F.lit(3600).cast("long"))
    return rounded(imputation.operational(imputation.impute_gaps(hourly, chunks=ordered.DAYS)), "value")


@query
def resample_events(w: World) -> DataFrame:
    return resample.rounded(resample.resample_events(w.price_events, *w.span))


@query
def national_mean(w: World) -> DataFrame:
    return resample.step_mean(resample.resample_events(w.price_events, *w.span))


@query
def late_retention(w: World) -> DataFrame:
    """Points younger than five years, seen in January 2029."""
    return apply_retention(w.points, datetime(2029, 1, 20)).select("series_id", "ts", "value")


@query
def metadata_filter(w: World) -> DataFrame:
    return filter_series(w.series, w.category, domains=["people", "traffic"], unit="money").select("series_id", "name", "unit")


@query
def date_filter(w: World) -> DataFrame:
    """Points from the first day to the end of the last, both given as text."""
    return w.points.filter(in_dates(F.col("ts"), "2024-01-10", "2024-01-12")).select("series_id", "ts", "value")
