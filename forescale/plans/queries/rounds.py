"""Rounds: status, choice of series, context, listings, forecasts and intake."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forescale.functions import durations
from forescale.functions.text import comma_list
from forescale.functions.times import floor_to, instant
from forescale.operators import forecasts as fc
from forescale.operators import rollup, rounds
from forescale.operators.availability import data_availability
from forescale.plans import lifecycle
from forescale.plans.queries.registry import ci_text, points_text, query, rounded, with_quantiles
from forescale.plans.world import AS_OF, REGISTRATION_AS_OF, SEED, World
from forescale.sources import scans


def _list(column: str):
    return F.concat_ws(",", F.col(column)).alias(column)


@query
def round_status(w: World) -> DataFrame:
    return rounds.round_status(w.rounds, w.definitions, AS_OF).select(
        "id", "name", "definition_name", "definition_schedule_id", _list("definition_domains"), "registration_start",
        "start_time", "end_time", "computed_status", "status",
    )


@query
def round_status_registration(w: World) -> DataFrame:
    return rounds.round_status(w.rounds, w.definitions, REGISTRATION_AS_OF).select("id", "computed_status", "status")


@query
def rounds_created(w: World) -> DataFrame:
    return w.created.select("id", "definition_id", "name", "registration_start", "registration_end", "start_time", "end_time")


@query
def eligible_series(w: World) -> DataFrame:
    return rounds.eligible_series(w.definitions, data_availability(w.series, w.category, w.points, AS_OF))


@query
def chosen_series(w: World) -> DataFrame:
    return lifecycle.choose(w.created, w.definitions, w.assignments, w.series, w.category, w.points, AS_OF, SEED)


@query
def context_snapshot(w: World) -> DataFrame:
    return rounded(rounds.context_snapshot(w.created, w.chosen, w.rollups), "value")


@query
def context_stats(w: World) -> DataFrame:
    return rounded(rollup.context_stats(w.context), "value_avg", "value_std")


@query
def context_range(w: World) -> DataFrame:
    return rounded(rollup.context_range(w.context), "latest_value")


@query
def series_pseudonyms(w: World) -> DataFrame:
    return rounded(rounds.series_pseudonyms(w.chosen, w.series, w.context), "value_avg", "value_std")


@query
def nested_context(w: World) -> DataFrame:
    rows = fc.nested_context(w.context, w.pseudo)
    return rows.select("round_id", "challenge_series_name", *points_text(F.col("data"), "value"))


@query
def context_of_rounds(w: World) -> DataFrame:
    """Context of the rounds that are active."""
    active = rounds.round_status(w.rounds, w.definitions, AS_OF).filter(F.col("status") == "active")
    return rounded(scans.context_of_rounds(w.context, active.select(F.col("id").alias("round_id"))), "value")


@query
def rounds_retimed(w: World) -> DataFrame:
    return rounds.retime_rounds(w.created, w.pseudo).select("id", "start_time", "end_time", "is_cancelled")


def _metadata(w: World) -> DataFrame:
    return rounds.rounds_with_metadata(w.rounds, w.definitions, w.pseudo, w.series, w.category, w.forecasts, AS_OF)


META = ["round_id", "definition_id", "name", "status", "computed_status", "n_time_series", "model_count", "forecast_count"]


@query
def rounds_with_metadata(w: World) -> DataFrame:
    return _metadata(w).select(*META, _list("domains"), _list("categories"), _list("subcategories"), "registration_start", "end_time")


@query
def list_rounds_filtered(w: World) -> DataFrame:
    kept = rounds.filter_rounds(
        _metadata(w), status=["active", "completed"], from_ts=datetime(2024, 1, 14), to_ts=datetime(2024, 1, 28),
        domains=["sales", "people"], categories=["shop", "users"], horizons_s=[259200],
    )
    return kept.select(*META)


def _listing(w: World) -> tuple[str, T.StructType]:
    """The listing in its order, stored once a session as ranges that pages seek in."""
    rows = _metadata(w).select(*META, "created_at")
    folder = f"{w.stage_root}/listing"
    if "listing" not in w.landed:
        rounds.store_listing(rows, rounds.status_order(), folder)
        w.landed.add("listing")
    return folder, rows.schema


@query
def list_rounds_page(w: World) -> DataFrame:
    return rounds.seek_page(w.spark, *_listing(w), rounds.status_order(), 2, 10).select(*META)


@query
def list_rounds_last_page(w: World) -> DataFrame:
    """The last page: as cheap as the first."""
    return rounds.seek_page(w.spark, *_listing(w), rounds.status_order(), 0, 10).select(*META)


@query
def list_rounds_page_info(w: World) -> DataFrame:
    return rounds.page_info(rounds.filter_rounds(_metadata(w), status=["completed"]), 2, 10)


@query
def filter_options(w: World) -> DataFrame:
    return rounds.filter_options(_metadata(w))


@query
def open_rounds(w: World) -> DataFrame:
    state = rounds.round_status(w.rounds, w.definitions, REGISTRATION_AS_OF)
    return rounds.open_rounds(state, ("registration", "active")).select("id", "name", "status", "registration_start")


@query
def round_series(w: World) -> DataFrame:
    return rounds.round_series(w.rounds, w.pseudo, w.series, w.category)


@query
def definition_series(w: World) -> DataFrame:
    return rounds.definition_series(rounds.round_series(w.rounds, w.pseudo, w.series, w.category))


@query
def current_definition_series(w: World) -> DataFrame:
    return rounds.current_series(w.assignments)


@query
def naive_forecast(w: World) -> DataFrame:
    return rounded(fc.naive_forecast(w.rounds, w.context), "predicted_value")


@query
def forecast_stats(w: World) -> DataFrame:
    return fc.forecast_stats(w.forecasts)


@query
def round_models(w: World) -> DataFrame:
    return fc.round_models(w.forecasts, w.models, w.users)


@query
def round_participants(w: World) -> DataFrame:
    return scans.participants(w.forecasts)


@query
def visible_forecasts(w: World) -> DataFrame:
    """Forecasts of rounds that are not in registration, as user 2 sees them."""
    state = rounds.round_status(w.rounds, w.definitions, REGISTRATION_AS_OF).select("id", "status")
    shown = rounds.owned(rounds.visible(w.forecasts, state), w.models, 2, False)
    return rounded(shown.select("round_id", "model_id", "series_id", "ts", "predicted_value"), "predicted_value")


@query
def list_forecasts(w: World) -> DataFrame:
    """Forecasts of every round that has begun, with public names."""
    begun = w.rounds.filter(F.col("start_time") <= instant(AS_OF)).select(F.col("id").alias("round_id"))
    wanted = scans.participants(w.forecasts).join(begun, "round_id", "left_semi")
    return with_quantiles(rounded(fc.list_forecasts(w.forecasts, w.pseudo, wanted), "predicted_value"))


@query
def series_forecasts_with_mase(w: World) -> DataFrame:
    rows = fc.series_forecasts_with_mase(w.forecasts, w.rounds, w.pseudo, w.served, w.models)
    return rounded(rows, "current_mase").select(
        "round_id", "series_id", "model_id", "readable_id", "current_mase", "n_evaluated", *points_text(F.col("points")), *ci_text(F.col("points"))
    )


def _wanted(w: World) -> DataFrame:
    """Every model with every series ever assigned to a definition."""
    return w.assignments.select("definition_id", "series_id").distinct().withColumn(
        "model_id", F.explode(F.array(*[F.lit(m) for m in range(1, 5)]))
    )


@query
def forecasts_across_rounds(w: World) -> DataFrame:
    rows = fc.forecasts_across_rounds(w.rounds, w.pseudo, w.forecasts, _wanted(w), "2024-01-11", "2024-01-21")
    return rows.select("model_id", "definition_id", "series_id", "round_id", "series_in_round", "forecast_exists", *points_text(F.col("points")), *ci_text(F.col("points")))


@query
def ground_truth(w: World) -> DataFrame:
    return rounded(fc.ground_truth(w.definitions, _wanted(w), w.rollups, "2024-01-11", "2024-01-21"), "value")


def _verdicts(w: World) -> DataFrame:
    return fc.admit_forecasts(w.submissions, w.models, w.rounds, w.pseudo)


@query
def admit_verdicts(w: World) -> DataFrame:
    return _verdicts(w)


def _stored(w: World) -> dict[str, DataFrame]:
    """Stored tables hold the first week of forecasts already."""
    old = w.forecasts.filter(F.col("created_at") < instant(datetime(2024, 1, 17)))
    seats = old.select("round_id", "model_id").distinct()
    pending = old.select("round_id", "model_id", "series_id").distinct().withColumn("final_evaluation", F.lit(False))
    return fc.store_submissions(w.submissions, _verdicts(w), old, seats, pending)


@query
def admit_forecast_rows(w: World) -> DataFrame:
    return with_quantiles(rounded(fc.accepted_rows(w.submissions, _verdicts(w)), "predicted_value"))


@query
def admit_new_forecasts(w: World) -> DataFrame:
    return with_quantiles(rounded(_stored(w)["forecasts"], "predicted_value"))


@query
def admit_new_participants(w: World) -> DataFrame:
    return _stored(w)["participants"]


@query
def admit_pending_scores(w: World) -> DataFrame:
    return _stored(w)["scores"]


@query
def admit_rejected(w: World) -> DataFrame:
    return _stored(w)["rejected"].groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum("received").alias("points"))


@query
def duration_texts(w: World) -> DataFrame:
    """Spans between a customer's orders in every text form, and back."""
    seconds = (F.col("o_orderkey") % 1000 * 900 + F.col("o_custkey") % 60).cast("long")
    texts = w.table("orders").select("o_orderkey", seconds.alias("s")).select(
        "o_orderkey", "s", durations.iso_text(F.col("s")).alias("iso"), durations.db_text(F.col("s")).alias("db"),
        F.concat((F.col("s") % 90).cast("string"), F.lit(" minutes")).alias("words"),
    )
    return texts.select(
        "o_orderkey", "iso", "db", durations.parse_seconds(F.col("iso")).alias("iso_s"), durations.db_text_seconds(F.col("db")).alias("db_s"),
        durations.parse_seconds(F.col("words")).alias("word_s"), durations.parse_seconds(F.lit("soon"), strict=False).alias("bad_s"),
        durations.resolution_of(F.col("s"), "raw").alias("resolution"), durations.expected_points(F.col("s"), F.lit(3600)).alias("points"),
    )


@query
def comma_lists(w: World) -> DataFrame:
    parts = comma_list(F.concat(F.col("p_type"), F.lit(" , "), F.col("p_brand"), F.lit(",, "), F.col("p_name")))
    return w.table("part").select("p_partkey", F.size(parts).alias("n"), F.array_join(parts, "|").alias("items"))


@query
def ten_minute_floor(w: World) -> DataFrame:
    return w.events.select("event_id", floor_to(F.col("ts"), 600).alias("ts"), F.round(F.col("value") / 7, 4).alias("value"))


@query
def active_definitions(w: World) -> DataFrame:
    """Active definitions with their rounds so far."""
    held = w.rounds.groupBy(F.col("definition_id").alias("id")).agg(F.count(F.lit(1)).alias("n_rounds"), F.max("end_time").alias("last_end"))
    return rounds.active_definitions(w.definitions).join(held, "id", "left").select("id", "schedule_id", "name", "n_rounds", "last_end")


@query
def definition_by_schedule(w: World) -> DataFrame:
    """One definition by its schedule id, with its rounds."""
    found = scans.find(w.definitions, schedule_id="s-daily").select(F.col("id").alias("definition_id"), "schedule_id", "is_active")
    return found.join(w.rounds.select("definition_id", F.col("id").alias("round_id"), "start_time"), "definition_id")


@query
def find_series(w: World) -> DataFrame:
    return scans.find(w.series, unique_id="ev-click").select("series_id", "name", "unit", "category_id")


@query
def models_of_user(w: World) -> DataFrame:
    """Models of one user with the rounds they forecast in."""
    seats = scans.participants(w.forecasts).groupBy(F.col("model_id").alias("id")).agg(F.count(F.lit(1)).alias("n_rounds"))
    return scans.models_of(w.models, user_id=2).join(seats, "id", "left").select("id", "name", "organization_id", "n_rounds")
