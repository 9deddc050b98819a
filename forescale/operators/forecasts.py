"""Forecasts: naive template, admission of submissions, listings and drill-downs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.functions.durations import expected_points, resolution_of
from forescale.functions.numeric import live_mase
from forescale.functions.times import in_dates, shift
from forescale.operators.ordered import unroll
from forescale.operators.scoring import live_pairs
from forescale.operators.upsert import insert_ignore

SUBMISSION = ["round_id", "model_name", "user_id", "submitted_at"]
#: Quantile forecasts of a point, level to value: ``map<string,double>``, NULL where none were given.
QUANTILES = "probabilistic_values"


def quantiles(rows: DataFrame):
    """The quantile column, or NULL where a table has none."""
    return F.col(QUANTILES) if QUANTILES in rows.columns else F.lit(None).cast("map<string,double>").alias(QUANTILES)


def points_in_order(value: str, name: str):
    """Points of a group by time as (ts, ``name``, ci); maps have no order, so they travel as entries."""
    entries = F.array_sort(F.map_entries(QUANTILES)).alias("ci")
    points = F.array_sort(F.collect_list(F.struct("ts", F.col(value).alias(name), entries)))
    return F.transform(points, lambda p: F.struct(p["ts"].alias("ts"), p[name].alias(name), F.map_from_entries(p["ci"]).alias("ci")))


def forecast_grid(rounds: DataFrame) -> DataFrame:
    """(round_id, ts) for every step from the start of the window to before its end."""
    steps = F.floor((F.unix_micros("end_time") - F.unix_micros("start_time") - 1) / (F.col("frequency_s") * 1_000_000))
    grid = rounds.filter((F.col("frequency_s") > 0) & (F.col("end_time") > F.col("start_time")))
    return unroll(grid, steps, "_k").select(F.col("id").alias("round_id"), shift(F.col("start_time"), F.col("_k") * F.col("frequency_s")).alias("ts"))


def naive_forecast(rounds: DataFrame, context: DataFrame) -> DataFrame:
    """Newest context value of every series on every step of its round."""
    newest = context.groupBy("round_id", "series_id").agg(F.max_by("value", "ts").alias("predicted_value"))
    return newest.join(forecast_grid(rounds), "round_id").select("round_id", "series_id", "ts", "predicted_value")


def admit_forecasts(
    submissions: DataFrame, models: DataFrame, rounds: DataFrame, pseudo: DataFrame
) -> DataFrame:
    """Submissions with model_id, series_id and ``error`` (NULL when admitted); the first failure wins.

    A submission is one upload: (round, model name, user, time). The first five checks concern
    the upload, the last two one series of it. Timestamps are not checked. Whether a window is
    open is judged at ``submitted_at``. The point count is a grouped count joined back, so a
    series with any number of rows never sits in one window.
    """
    owner = models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"), "user_id")
    windows = rounds.select(
        F.col("id").alias("round_id"), "registration_start", "registration_end",
        expected_points(F.col("horizon_s"), F.col("frequency_s")).alias("_expected"), F.lit(True).alias("_round"),
    )
    names = pseudo.select("round_id", "challenge_series_name", "series_id")
    per_series = [*SUBMISSION, "challenge_series_name"]
    now = F.col("submitted_at")
    error = (
        F.when(F.col("model_id").isNull(), "model_not_owned")
        .when(F.col("_round").isNull(), "unknown_round")
        .when(F.col("registration_start").isNull() | F.col("registration_end").isNull(), "window_not_configured")
        .when(now < F.col("registration_start"), "registration_not_started")
        .when(now > F.col("registration_end"), "registration_ended")
        .when(F.col("series_id").isNull(), "unknown_series")
        .when(F.col("_expected").isNotNull() & (F.col("received") != F.col("_expected")), "wrong_point_count")
    )
    verdicts = (
        submissions.groupBy(*per_series).agg(F.count(F.lit(1)).alias("received"))
        .join(owner, ["model_name", "user_id"], "left")
        .join(windows, "round_id", "left")
        .join(names, ["round_id", "challenge_series_name"], "left")
        .select(*per_series, "model_id", "series_id", "received", F.col("_expected").alias("expected"), error.alias("error"))
    )
    return verdicts


def accepted_rows(submissions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Forecast rows of admitted series, the first point per key winning."""
    keys = [*SUBMISSION, "challenge_series_name"]
    good = verdicts.filter(F.col("error").isNull()).select(*keys, "model_id", "series_id")
    return submissions.withColumn(QUANTILES, quantiles(submissions)).join(good, keys).select(
        "round_id", "model_id", "series_id", "ts", F.col("value").alias("predicted_value"), F.col("submitted_at").alias("created_at"),
        QUANTILES,
    )


def store_submissions(
    submissions: DataFrame, verdicts: DataFrame, forecasts: DataFrame, participants: DataFrame, scores: DataFrame
) -> dict[str, DataFrame]:
    """Rows to append to each table. Only uploads that pass the first five checks register a participant."""
    keys = ["round_id", "model_id", "series_id"]
    rows = accepted_rows(submissions, verdicts)
    new_forecasts = insert_ignore(forecasts, rows, [*keys, "ts"], ["created_at"])
    passed = verdicts.filter(F.col("error").isNull() | F.col("error").isin("unknown_series", "wrong_point_count"))
    new_participants = insert_ignore(participants, passed.select("round_id", "model_id").distinct(), ["round_id", "model_id"])
    pending = new_forecasts.select(*keys).distinct().withColumn("final_evaluation", F.lit(False))
    return {
        "forecasts": new_forecasts,
        "participants": new_participants,
        "scores": insert_ignore(scores.select(*keys, "final_evaluation"), pending, keys),
        "rejected": verdicts.filter(F.col("error").isNotNull()),
    }


def with_series_names(rows: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Public name of each (round, series), or ``series_<id>`` where none is stored."""
    names = pseudo.select("round_id", "series_id", F.col("challenge_series_name").alias("_name"))
    fallback = F.concat(F.lit("series_"), F.col("series_id").cast("string"))
    return rows.join(names, ["round_id", "series_id"], "left").withColumn(
        "challenge_series_name", F.coalesce(F.col("_name"), fallback)
    ).drop("_name")


def list_forecasts(forecasts: DataFrame, pseudo: DataFrame, wanted: DataFrame) -> DataFrame:
    """Forecast rows of the (round, model[, series]) keys with public names, by series and time."""
    keys = [c for c in ("round_id", "model_id", "series_id") if c in wanted.columns]
    rows = forecasts.join(wanted.select(*keys).distinct(), keys, "left_semi")
    created = F.col("created_at") if "created_at" in rows.columns else F.lit(None).cast("timestamp").alias("created_at")
    named = with_series_names(rows.select("round_id", "model_id", "series_id", "ts", "predicted_value", quantiles(rows), created), pseudo)
    return named.orderBy("series_id", "ts", "round_id", "model_id")


def forecast_stats(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("round_id", "model_id", "series_id").agg(
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("forecast_count")
    )


def round_models(forecasts: DataFrame, models: DataFrame, users: DataFrame) -> DataFrame:
    """Models that forecast in each round."""
    seen = forecasts.select("round_id", "model_id").distinct()
    dims = models.join(users.select(F.col("id").alias("user_id"), "username"), "user_id").select(
        F.col("id").alias("model_id"), "readable_id", F.coalesce("name", F.lit("model")).alias("model_name"), "username"
    )
    return seen.join(dims, "model_id").select("round_id", "model_id", "readable_id", "model_name", "username")


def series_forecasts_with_mase(
    forecasts: DataFrame, rounds: DataFrame, pseudo: DataFrame, rollups: DataFrame, models: DataFrame
) -> DataFrame:
    """Per round, series and model: points in time order and the error so far.

    Series without a value at the context end show nothing. Arrays hold one round's horizon.
    """
    pairs = live_pairs(forecasts.withColumn(QUANTILES, quantiles(forecasts)), rounds, pseudo, rollups, baseline="inner")
    known = F.col("actual").isNotNull() & F.col("predicted_value").isNotNull() & F.col("baseline").isNotNull()
    labels = models.select(F.col("id").alias("model_id"), "readable_id", F.col("name").alias("model_name"))
    return (
        pairs.groupBy("round_id", "series_id", "model_id")
        .agg(
            F.sum(F.when(known, F.abs(F.col("predicted_value") - F.col("actual")))).alias("_model"),
            F.sum(F.when(known, F.abs(F.col("baseline") - F.col("actual")))).alias("_naive"),
            F.count_if(known).alias("n_evaluated"),
            points_in_order("predicted_value", "y").alias("points"),
        )
        .withColumn("current_mase", live_mase(F.col("_model"), F.col("_naive"), F.col("n_evaluated")))
        .join(labels, "model_id")
        .select("round_id", "series_id", "model_id", "readable_id", "model_name", "current_mase", "n_evaluated", "points")
    )


def forecasts_across_rounds(
    rounds: DataFrame, pseudo: DataFrame, forecasts: DataFrame, wanted: DataFrame,
    first_day: str | None = None, last_day: str | None = None,
) -> DataFrame:
    """For (model, definition, series) keys: every round of the definition with flags and points.

    Tells apart: series not in the round, in it without forecast, in it with forecast.
    """
    keys = wanted.select("model_id", "definition_id", "series_id").distinct()
    all_rounds = rounds.select(F.col("id").alias("round_id"), "definition_id", F.col("name").alias("round_name"), "start_time", "end_time")
    members = pseudo.select("round_id", "series_id", F.lit(True).alias("_in"))
    rows = (
        forecasts.withColumn(QUANTILES, quantiles(forecasts)).filter(in_dates(F.col("ts"), first_day, last_day))
        .groupBy("round_id", "model_id", "series_id")
        .agg(points_in_order("predicted_value", "y").alias("_points"))
    )
    inside = F.coalesce(F.col("_in"), F.lit(False))
    return (
        keys.join(all_rounds, "definition_id")
        .join(members, ["round_id", "series_id"], "left")
        .join(rows, ["round_id", "model_id", "series_id"], "left")
        .select(
            "model_id", "definition_id", "series_id", "round_id", "round_name", "start_time", "end_time",
            inside.alias("series_in_round"), (inside & F.col("_points").isNotNull()).alias("forecast_exists"),
            F.when(inside, F.col("_points")).alias("points"),
        )
    )


def ground_truth(
    definitions: DataFrame, wanted: DataFrame, rollups: DataFrame, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """Actual values of the (definition, series) keys at the definition's resolution."""
    keys = wanted.select("definition_id", "series_id").distinct()
    levels = definitions.select(F.col("id").alias("definition_id"), resolution_of(F.col("frequency_s")).alias("resolution"))
    kept = rollups.filter(in_dates(F.col("ts"), first_day, last_day)).select("resolution", "series_id", "ts", "value")
    return keys.join(levels, "definition_id").join(kept, ["resolution", "series_id"]).select("definition_id", "series_id", "ts", "value")


def nested_context(context: DataFrame, pseudo: DataFrame) -> DataFrame:
    """One row per round and public series name with its points in time order (at most a context length)."""
    named = with_series_names(context, pseudo)
    return named.groupBy("round_id", "challenge_series_name").agg(
        F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("data")
    )
