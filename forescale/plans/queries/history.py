"""Versioned tables, point-in-time reads and export."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.functions.times import instant
from forescale.operators import export
from forescale.operators import history as hist
from forescale.plans.queries.registry import ci_text, points_text, query, rounded, shown, with_quantiles
from forescale.plans.world import AS_OF, World

VERSION = ["series_id", "ts", "value", "quality_code", "valid_from", "valid_to", "is_current"]
MERGE_AT = datetime(2024, 2, 3)


def _batch(w: World) -> DataFrame:
    """Every point from 10 January on: errors 10 percent up, purchases now imputed, clicks sent twice with the last right."""
    kind = w.type_series()
    rows = w.events.filter(F.col("ts") >= instant(datetime(2024, 1, 10))).select(
        F.explode(F.array(kind, (F.col("user_id") + 100_000).cast("int"))).alias("series_id"), "ts",
        F.when(F.col("event_type") == "error", F.col("value") * 1.1).otherwise(F.col("value")).alias("_right"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("short").alias("quality_code"),
        F.when(F.col("event_type") == "click", 2).otherwise(1).alias("_sent"), "event_id",
    )
    sent = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_sent"))))
    return sent.select(
        "series_id", "ts", F.when(F.col("_n") < F.col("_sent"), F.col("_right") + 5).otherwise(F.col("_right")).alias("value"),
        "quality_code", (F.col("event_id") * 10 + F.col("_n")).alias("batch_seq"),
    )


def _merged(w: World) -> DataFrame:
    return hist.merge_points(w.history, _batch(w), MERGE_AT)


@query
def scd2_merge(w: World) -> DataFrame:
    return rounded(_merged(w), "value")


@query
def scd2_counts(w: World) -> DataFrame:
    return hist.merge_counts(_merged(w), _batch(w))


@query
def as_of_snapshot(w: World) -> DataFrame:
    rows = hist.at_time(w.history, datetime(2024, 1, 15, 12), start=datetime(2024, 1, 3), end=datetime(2024, 1, 15))
    return rounded(rows.select(*VERSION), "value")


@query
def points_at_time(w: World) -> DataFrame:
    """The same read as a SQL table function."""
    hist.register_at_time(w.history)
    return rounded(w.spark.sql("SELECT * FROM points_at_time(TIMESTAMP '2024-01-15 12:00:00')"), "value")


@query
def current_snapshot(w: World) -> DataFrame:
    return hist.current(w.history).select("series_id", "ts", "value", "valid_from")


@query
def value_history(w: World) -> DataFrame:
    """All versions of the points that were corrected."""
    corrected = w.history.filter(~F.col("is_current")).select("series_id", "ts")
    return rounded(hist.value_history(w.history, corrected).select(*VERSION), "value")


@query
def changes_summary(w: World) -> DataFrame:
    return hist.changes_summary(w.history, datetime(2024, 1, 3), datetime(2024, 1, 28))


def _instants(w: World) -> DataFrame:
    return hist.round_instants(w.rounds, w.scores, AS_OF)


@query
def round_instants(w: World) -> DataFrame:
    return _instants(w)


@query
def round_context(w: World) -> DataFrame:
    """Context of the rounds as known at their creation, per round and series."""
    rows = hist.round_context(_instants(w), w.pseudo, w.history)
    return rounded(rows.groupBy("round_id", "series_id", "challenge_series_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("value").alias("total")
    ), "total")


@query
def points_known_at(w: World) -> DataFrame:
    """What was known of each round's series at its creation, start, end and evaluation: four instants a round at once."""
    moments = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).alias("moment")) for name in ("created_at", "start_time", "end_time", "eval_time")])
    asked = w.pseudo.select("round_id", "series_id").join(_instants(w), "round_id").select("round_id", "series_id", F.explode(moments).alias("m"))
    known = hist.versions_at(w.history, asked.select("round_id", "series_id", "m.*"), "moment")
    return rounded(known.groupBy("round_id", "series_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.sum("value").alias("total")), "total")


@query
def round_actuals(w: World) -> DataFrame:
    return rounded(hist.round_actuals(_instants(w), w.pseudo, w.history), "value")


@query
def round_forecasts(w: World) -> DataFrame:
    return with_quantiles(rounded(hist.round_forecasts(_instants(w), w.pseudo, w.forecasts, w.models), "value"))


@query
def round_complete_data(w: World) -> DataFrame:
    """Context, actuals and forecasts nested per series; shown flat, one row per model."""
    instants = _instants(w)
    nested = hist.nested_round(
        hist.round_actuals(instants, w.pseudo, w.history), hist.round_forecasts(instants, w.pseudo, w.forecasts, w.models),
        hist.round_context(instants, w.pseudo, w.history),
    )
    known = F.coalesce(F.size("context"), F.lit(0)).alias("n_context")
    last = shown(F.try_element_at("context", F.lit(-1))["value"]).alias("context_last")
    flat = nested.select(
        "round_id", "series_id", known, last, F.coalesce(F.size("actuals"), F.lit(0)).alias("n_actuals"), F.explode_outer("forecasts").alias("readable_id", "_p")
    )
    return flat.select(
        "round_id", "series_id", "n_context", "context_last", "n_actuals", "readable_id", *points_text(F.col("_p"), "value"), *ci_text(F.col("_p"))
    )


@query
def export_month(w: World) -> DataFrame:
    """The January export, written and read back: rows and values per dataset and round."""
    tables = export.export_tables(
        w.rounds, w.definitions, w.pseudo, w.history, w.scores, w.forecasts, w.models, AS_OF, 2024, 1
    )
    folder = f"{w.stage_root}/export"
    export.write_export(tables, folder)
    out = None
    for name, rows in tables.items():
        back = w.spark.read.schema(rows.schema).parquet(f"{folder}/{name}")
        value = F.sum("value") if "value" in rows.columns else F.sum("definition_id").cast("double")
        part = back.groupBy("round_id").agg(F.count(F.lit(1)).alias("n"), value.alias("total")).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "total")


# Assignments: every customer is a series of its nation's definition.

SYNC_AT = datetime(2024, 3, 1)


def _assignments(w: World) -> DataFrame:
    c = w.table("customer")
    return c.select(
        F.col("c_nationkey").alias("definition_id"), F.col("c_custkey").cast("int").alias("series_id"), (F.col("c_acctbal") > 0).alias("is_required"),
        (F.col("c_acctbal") > 9000).alias("is_excluded"), instant(datetime(2024, 1, 1)).alias("valid_from"),
        F.when(F.col("c_mktsegment") == "MACHINERY", instant(datetime(2024, 2, 1))).alias("valid_to"),
        (F.col("c_mktsegment") != "MACHINERY").alias("is_current"),
    )


def _listed(w: World) -> DataFrame:
    return w.table("customer").filter(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_nationkey").alias("definition_id"), F.col("c_custkey").cast("int").alias("series_id"), (F.col("c_acctbal") > 1000).alias("is_required")
    )


@query
def sync_assignments(w: World) -> DataFrame:
    """Listed customers stay or reopen, others close, in the nations of every region but the second."""
    managed = w.table("nation").filter(F.col("n_regionkey") != 1).select(F.col("n_nationkey").alias("definition_id"))
    return hist.sync_assignments(_assignments(w), _listed(w).join(managed, "definition_id", "left_semi"), managed, SYNC_AT)


@query
def mark_excluded(w: World) -> DataFrame:
    pairs = w.table("customer").filter(F.col("c_mktsegment") == "FURNITURE").select(
        F.col("c_nationkey").alias("definition_id"), F.col("c_custkey").cast("int").alias("series_id")
    )
    return hist.mark_excluded(_assignments(w), pairs)
