"""Scores of all rounds, models and series at once, and round leaderboards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forescale.functions.durations import resolution_of, resolution_seconds
from forescale.functions.numeric import INF, finite_or_null, live_mase, stored_mase, tie_key
from forescale.functions.text import percent
from forescale.functions.times import instant, minute_of, shift
from forescale.operators.rounds import status_of

KEYS = ["round_id", "model_id", "series_id"]

# Rules of the score states.
TIMEOUT_S = 86400
MIN_COVERAGE = 0.95
FINALISE_BUFFER_S = 3600
MESSAGE_CHARS = 500
NO_CONTEXT = "No context point available for naive forecast baseline"
NO_OVERLAP = "No overlapping timestamps between forecasts and actuals"


def known_by(rollups: DataFrame, as_of: datetime | str) -> DataFrame:
    """Buckets that were closed at the instant."""
    return rollups.filter(shift(F.col("ts"), resolution_seconds(F.col("resolution"))) <= instant(as_of))


def round_levels(rounds: DataFrame) -> DataFrame:
    return rounds.select(F.col("id").alias("round_id"), "end_time", resolution_of(F.col("frequency_s")).alias("resolution"))


def baselines(pseudo: DataFrame, rounds: DataFrame, rollups: DataFrame) -> DataFrame:
    """Value at the context end of every (round, series) that has one."""
    ends = (
        pseudo.filter(F.col("max_ts").isNotNull()).select("round_id", "series_id", F.col("max_ts").alias("ts"))
        .join(round_levels(rounds), "round_id")
    )
    return ends.join(rollups.select("resolution", "series_id", "ts", "value"), ["series_id", "ts", "resolution"]).select(
        "round_id", "series_id", F.col("value").alias("baseline")
    )


def align(forecasts: DataFrame, rounds: DataFrame, rollups: DataFrame) -> DataFrame:
    """Forecasts with the actual of the same series and minute at the round's resolution."""
    tagged = forecasts.join(round_levels(rounds), "round_id").withColumn("_minute", minute_of(F.col("ts")))
    actuals = rollups.select("resolution", "series_id", minute_of(F.col("ts")).alias("_minute"), F.col("value").alias("actual"))
    return tagged.join(actuals, ["series_id", "_minute", "resolution"])


def evaluate(
    forecasts: DataFrame, rounds: DataFrame, pseudo: DataFrame, rollups: DataFrame, as_of: datetime | str,
    timeout_s: int = TIMEOUT_S, min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """Score rows of every (round, model, series) with forecasts, as known at ``as_of``.

    One left join by (series, minute, resolution), whose keys are fine enough that a hot series
    spreads over all tasks, then one grouped pass with map-side sums. Keys begin with the series,
    of which there are most: sorts compare the first key quickly.
    """
    known = known_by(rollups, as_of)
    actuals = known.select("resolution", "series_id", minute_of(F.col("ts")).alias("_minute"), F.col("value").alias("_actual"))
    ends = baselines(pseudo, rounds, known)
    tagged = (
        forecasts.select(*KEYS, "ts", "predicted_value")
        .join(round_levels(rounds), "round_id")
        .withColumn("_minute", minute_of(F.col("ts")))
    )
    pairs = tagged.join(actuals, ["series_id", "_minute", "resolution"], "left").join(ends, ["series_id", "round_id"], "left")
    error = F.col("_actual") - F.col("predicted_value")
    sums = pairs.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("forecast_count"),
        F.count("_actual").alias("aligned"),
        F.sum(F.abs(error)).alias("absolute"),
        F.sum(F.abs(F.col("_actual") - F.col("baseline"))).alias("naive"),
        F.sum(error * error).alias("square"),
        F.max("baseline").isNotNull().alias("has_baseline"),
        F.max("end_time").alias("end_time"),
    )
    return score_states(sums, as_of, timeout_s, min_coverage)


def score_states(sums: DataFrame, as_of: datetime | str, timeout_s: int = TIMEOUT_S, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Score rows from error sums per (round, model, series): counts, sums over aligned forecasts, baseline and round end."""
    coverage = F.col("aligned") / F.col("forecast_count")
    late = instant(as_of) > shift(F.col("end_time"), timeout_s)
    states = sums.withColumn("data_coverage", F.when(F.col("has_baseline"), coverage).otherwise(F.lit(0.0))).withColumn(
        "evaluation_status",
        F.when(~F.col("has_baseline"), "error")
        .when(F.col("aligned") == 0, "no_overlap")
        .when(F.col("aligned") >= F.col("forecast_count"), "complete")
        .when(late & (coverage < min_coverage), "insufficient_data")
        .otherwise("partial"),
    )
    state = F.col("evaluation_status")
    scored = state.isin("complete", "partial")
    mean = lambda name: F.col(name) / F.nullif(F.col("aligned"), F.lit(0))
    counted = F.when(state == "error", F.lit(0)).otherwise(F.col("aligned")).cast("long")
    message = (
        F.when(state == "error", F.lit(NO_CONTEXT))
        .when(state == "no_overlap", F.lit(NO_OVERLAP))
        .when(
            state == "insufficient_data",
            F.concat(F.lit("Timeout: only "), percent(F.col("data_coverage")), F.lit(f" coverage (min {min_coverage:.0%} required)")),
        )
    )
    return states.select(
        *KEYS,
        F.when(scored, stored_mase(mean("absolute"), mean("naive"))).alias("mase"),
        F.when(scored, F.sqrt(mean("square"))).alias("rmse"),
        "forecast_count", counted.alias("actual_count"), counted.alias("evaluated_count"), "data_coverage",
        (state.isin("complete", "insufficient_data") | (scored & late)).alias("final_evaluation"),
        "evaluation_status", F.substring(message, 1, MESSAGE_CHARS).alias("error_message"),
    )


def needs_evaluation(rounds: DataFrame, scores: DataFrame, as_of: datetime | str) -> DataFrame:
    """Active or completed rounds with no score, or one that is not final; cancelled ones included."""
    running = rounds.filter(status_of(instant(as_of)).isin("active", "completed")).select(F.col("id").alias("round_id"))
    state = scores.groupBy("round_id").agg(F.bool_and("final_evaluation").alias("_all_final"))
    return running.join(state, "round_id", "left").filter(
        F.col("_all_final").isNull() | ~F.col("_all_final")
    ).select("round_id")


def score_completeness(scores: DataFrame) -> DataFrame:
    """Total and complete scores per round, and whether all are complete."""
    return scores.groupBy("round_id").agg(
        F.count(F.lit(1)).alias("total_scores"),
        F.count_if(F.col("evaluation_status") == "complete").alias("complete_scores"),
    ).withColumn("all_complete", F.col("total_scores") == F.col("complete_scores"))


def can_finalise(rounds: DataFrame, scores: DataFrame, as_of: datetime | str) -> DataFrame:
    """Rounds past their end and buffer whose scores are all complete."""
    past = rounds.filter(instant(as_of) >= shift(F.col("end_time"), FINALISE_BUFFER_S)).select(F.col("id").alias("round_id"))
    return past.join(score_completeness(scores).filter("all_complete"), "round_id").select("round_id")


def without_excluded(scores: DataFrame, rounds: DataFrame, assignments: DataFrame) -> DataFrame:
    """Scores with definition_id, without series ever excluded from it; rounds without a definition stay."""
    banned = assignments.filter("is_excluded").select("definition_id", "series_id").distinct()
    tagged = scores.join(rounds.select(F.col("id").alias("round_id"), "definition_id"), "round_id")
    return tagged.join(banned, ["definition_id", "series_id"], "left_anti")


def final_leaderboard(scores: DataFrame, rounds: DataFrame, assignments: DataFrame, models: DataFrame, series: DataFrame) -> DataFrame:
    """Stored final scores ranked per round and series; infinite errors rank last and show as NULL.

    The ranking window is per (round, series) and holds one row per model.
    """
    kept = without_excluded(scores.filter(F.col("final_evaluation") & F.col("mase").isNotNull()), rounds, assignments)
    best = W.partitionBy("round_id", "series_id").orderBy(F.asc_nulls_last(tie_key(F.col("mase"))))
    ranked = kept.withColumn("rank", F.rank().over(best))
    return _labelled(ranked, models, series).select(
        *KEYS, "readable_id", "model_name", "series_name", "forecast_count",
        finite_or_null(F.col("mase")).alias("mase"), finite_or_null(F.col("rmse")).alias("rmse"),
        "rank", F.lit(True).alias("is_final"),
    )


def _labelled(rows: DataFrame, models: DataFrame, series: DataFrame) -> DataFrame:
    who = models.select(F.col("id").alias("model_id"), "readable_id", F.col("name").alias("model_name"))
    what = series.select("series_id", F.col("name").alias("series_name"))
    return rows.join(who, "model_id").join(what, "series_id", "left")


def live_pairs(forecasts: DataFrame, rounds: DataFrame, pseudo: DataFrame, rollups: DataFrame, baseline: str = "left") -> DataFrame:
    """Forecasts with the actual of exactly the same instant, and the value at the context end."""
    more = [c for c in forecasts.columns if c == "probabilistic_values"]
    tagged = forecasts.select(*KEYS, "ts", "predicted_value", *more).join(round_levels(rounds), "round_id")
    actuals = rollups.select("resolution", "series_id", "ts", F.col("value").alias("actual"))
    return tagged.join(actuals, ["series_id", "ts", "resolution"], "left").join(
        baselines(pseudo, rounds, rollups), ["series_id", "round_id"], baseline
    )


def live_leaderboard(
    forecasts: DataFrame, rounds: DataFrame, pseudo: DataFrame, rollups: DataFrame, models: DataFrame, series: DataFrame
) -> DataFrame:
    """Errors so far, ranked 1..n per round and series; series without any valid error are left out."""
    pairs = live_pairs(forecasts, rounds, pseudo, rollups)
    known = F.col("actual").isNotNull() & F.col("predicted_value").isNotNull() & F.col("baseline").isNotNull()
    sums = pairs.groupBy(*KEYS).agg(
        F.sum(F.when(known, F.abs(F.col("predicted_value") - F.col("actual")))).alias("_model"),
        F.sum(F.when(known, F.abs(F.col("baseline") - F.col("actual")))).alias("_naive"),
        F.count_if(known).alias("forecast_count"),
    )
    scored = sums.withColumn("mase", live_mase(F.col("_model"), F.col("_naive"), F.col("forecast_count")))
    labelled = _labelled(scored, models, series)
    group = W.partitionBy("round_id", "series_id")
    order = group.orderBy(F.asc_nulls_last(tie_key(F.col("mase"))), "model_name", "model_id")
    valid = F.max(F.col("mase").isNotNull() & (F.col("mase") != F.lit(INF))).over(group)
    return (
        labelled.withColumn("_valid", valid).withColumn("rank", F.row_number().over(order)).filter("_valid")
        .select(*KEYS, "readable_id", "model_name", "series_name", "forecast_count", "mase",
                F.lit(None).cast("double").alias("rmse"), "rank", F.lit(False).alias("is_final"))
    )


def round_leaderboard(
    scores: DataFrame, forecasts: DataFrame, rounds: DataFrame, pseudo: DataFrame, rollups: DataFrame,
    assignments: DataFrame, models: DataFrame, series: DataFrame,
) -> DataFrame:
    """Stored scores for rounds with any final score, errors so far for the others."""
    done = scores.filter("final_evaluation").select("round_id").distinct()
    running = forecasts.join(done, "round_id", "left_anti")
    live = live_leaderboard(running, rounds, pseudo, rollups, models, series)
    return final_leaderboard(scores, rounds, assignments, models, series).unionByName(live)


def model_in_round(scores: DataFrame) -> DataFrame:
    """Performance of each model in each round over its scored series."""
    finite = finite_or_null(F.col("mase"))
    return scores.groupBy("round_id", "model_id").agg(
        F.count(F.lit(1)).alias("n_series"), F.avg(finite).alias("avg_mase"), F.avg(finite_or_null(F.col("rmse"))).alias("avg_rmse"),
        F.avg("data_coverage").alias("avg_coverage"),
    )


def scores_of_rounds(scores: DataFrame, round_ids: DataFrame) -> DataFrame:
    """Scores of the given rounds, best first."""
    rows = scores.join(round_ids.select("round_id").distinct(), "round_id", "left_semi")
    return rows.orderBy("round_id", F.asc_nulls_last("mase"), "model_id", "series_id")
