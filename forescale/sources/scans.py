"""Reads of points, rollups and entities. Filters are plain predicates, so they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.functions.durations import RESOLUTION_SECONDS, resolution_of
from forescale.functions.times import instant
from forescale.operators.ordered import last_n

COLUMNS = ["series_id", "ts", "value", "sample_count"]


def scan_points(
    points: DataFrame, start: datetime | str, end: datetime | str, series: Iterable[int] | DataFrame | None = None
) -> DataFrame:
    """Points with both ends included; ``series`` is a list of ids or a keys table."""
    kept = points.filter(F.col("ts").between(instant(start), instant(end)))
    if isinstance(series, DataFrame):
        return kept.join(series.select("series_id").distinct(), "series_id", "left_semi")
    return kept if series is None else kept.filter(F.col("series_id").isin(list(series)))


def by_resolution(points: DataFrame, rollups: DataFrame, resolution: str, unknown: str = "error") -> DataFrame:
    """Rows at a resolution; an unknown one is an error, or falls back to ``unknown``."""
    if resolution not in (*RESOLUTION_SECONDS, "raw"):
        if unknown == "error":
            raise ValueError(f"unknown resolution: {resolution}")
        resolution = unknown
    if resolution == "raw":
        return points.select("series_id", "ts", "value", F.lit(1).cast("long").alias("sample_count"))
    return rollups.filter(F.col("resolution") == resolution).select(*COLUMNS)


def scan_by_resolution(
    points: DataFrame, rollups: DataFrame, resolution: str, start: datetime | str, end: datetime | str,
    series: Iterable[int] | DataFrame | None = None, unknown: str = "error",
) -> DataFrame:
    return scan_points(by_resolution(points, rollups, resolution, unknown), start, end, series)


def series_data_for_rounds(rounds: DataFrame, pseudo: DataFrame, rollups: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Rows of every round's series at the round's own resolution."""
    wanted = pseudo.select("round_id", "series_id").join(
        rounds.select(F.col("id").alias("round_id"), resolution_of(F.col("frequency_s")).alias("resolution")), "round_id"
    )
    kept = rollups.filter(F.col("ts").between(instant(start), instant(end)))
    return kept.join(wanted, ["resolution", "series_id"]).select("round_id", "resolution", *COLUMNS)


def get_data(
    catalogue: DataFrame, points: DataFrame, rollups: DataFrame, unique_ids: Iterable[str] | None, as_of: datetime,
    start: datetime | str | None = None, end: datetime | str | None = None, resolution: str = "raw",
) -> DataFrame:
    """Points by unique id (all when None); the last seven days when either bound is missing."""
    if start is None or end is None:
        moment = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
        start, end = moment - timedelta(days=7), moment
    wanted = catalogue if unique_ids is None else catalogue.filter(F.col("unique_id").isin(list(unique_ids)))
    ids = wanted.select("series_id", "unique_id")
    rows = scan_by_resolution(points, rollups, resolution, start, end)
    return rows.join(ids, "series_id").select("unique_id", *COLUMNS)


def last_points(points: DataFrame, n: int, before: datetime | str | None = None) -> DataFrame:
    """Newest ``n`` points of every series, optionally before an instant (exclusive)."""
    kept = points if before is None else points.filter(F.col("ts") < instant(before))
    return last_n(kept, ["series_id"], "ts", n)


def point_summary(points: DataFrame) -> DataFrame:
    """Newest instant and number of points of every series."""
    return points.groupBy("series_id").agg(F.max("ts").alias("latest_ts"), F.count(F.lit(1)).alias("n_points"))


def find(table: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns equal the given values: a series by unique_id, a round by name, a model by id."""
    kept = table
    for column, value in equal.items():
        kept = kept.filter(F.col(column) == F.lit(value))
    return kept


def context_of_rounds(context: DataFrame, rounds: DataFrame) -> DataFrame:
    """Context rows of the rounds (and series, when given) in a keys table."""
    keys = [c for c in ("round_id", "series_id") if c in rounds.columns]
    return context.join(rounds.select(*keys).distinct(), keys, "left_semi")


def participants(forecasts: DataFrame) -> DataFrame:
    return forecasts.select("round_id", "model_id").distinct()


def models_of(models: DataFrame, users: DataFrame | None = None, **equal: object) -> DataFrame:
    """Models by id, user or (name, user); a ``users`` table narrows to its owners."""
    kept = find(models, **equal)
    if users is not None:
        kept = kept.join(users.select(F.col("id").alias("user_id")).distinct(), "user_id", "left_semi")
    return kept
