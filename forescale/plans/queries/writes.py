"""Keyed writes: each query returns the table as it is after the write."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.functions.times import instant, shift
from forescale.operators import scoring, upsert
from forescale.plans.queries.registry import query, rounded
from forescale.plans.world import AS_OF, LATE, World

CUT, BACK = datetime(2024, 1, 20), datetime(2024, 1, 15)


@query
def upsert_points(w: World) -> DataFrame:
    """Points up to 20 January, then all from the 15th on delivered again twice, the second time 1 higher."""
    stored = w.points.filter(F.col("ts") < instant(CUT)).select("series_id", "ts", "value", instant(CUT).alias("updated_at"))
    again = w.points.filter(F.col("ts") >= instant(BACK)).withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1))))
    batch = again.select("series_id", "ts", (F.col("value") + F.col("_n")).alias("value"), (F.col("event_id") * 2 + F.col("_n")).alias("batch_seq"))
    return rounded(upsert.upsert_points(stored, batch, AS_OF), "value")


@query
def insert_ignore_events(w: World) -> DataFrame:
    """Per user and type the first event, unless the user and type had an event before the cut."""
    rows = w.events.select("user_id", "event_type", "ts", "value")
    return upsert.insert_ignore(rows.filter(F.col("ts") < instant(datetime(2024, 1, 3))), rows, ["user_id", "event_type"], ["ts"])


@query
def upsert_scores(w: World) -> DataFrame:
    state = upsert.upsert_scores(w.scores, w.late_scores.drop("calculated_at"), LATE)
    return rounded(state.select("round_id", "model_id", "series_id", "mase", "final_evaluation", "evaluation_status", "calculated_at"), "mase")


@query
def upsert_rankings(w: World) -> DataFrame:
    """Snapshots with every rank moved by one, written over the stored ones; the global scope has no id."""
    fresh = w.rankings.filter(F.col("scope_type") != "definition").withColumn("rank_position", F.col("rank_position") + 1)
    return upsert.upsert_rankings(w.rankings, fresh).select("calculation_date", "model_id", "scope_type", "scope_id", "rank_position")


@query
def upsert_series_pseudo(w: World) -> DataFrame:
    fresh = w.pseudo.filter(F.col("value_std") > 30).withColumn("challenge_series_name", F.concat(F.lit("new_"), "challenge_series_name"))
    return upsert.upsert_series_pseudo(w.pseudo, fresh).select("round_id", "series_id", "challenge_series_name", "max_ts")


@query
def finalise_scores(w: World) -> DataFrame:
    due = scoring.score_completeness(w.scores).filter(F.col("complete_scores") * 2 > F.col("total_scores")).select("round_id")
    return upsert.finalise_scores(w.scores, due).groupBy("round_id", "final_evaluation").agg(F.count(F.lit(1)).alias("n"))


def _doomed(w: World) -> DataFrame:
    return w.late_scores.filter(F.col("evaluation_status") == "insufficient_data").select("round_id", "model_id", "series_id")


@query
def delete_forecasts(w: World) -> DataFrame:
    kept, _ = upsert.delete_forecasts(w.forecasts, _doomed(w))
    return rounded(kept.select("round_id", "model_id", "series_id", "ts", "predicted_value"), "predicted_value")


@query
def deleted_forecasts(w: World) -> DataFrame:
    return upsert.delete_forecasts(w.forecasts, _doomed(w))[1]


@query
def cancel_rounds(w: World) -> DataFrame:
    """Rounds that lost more than half of their scores to missing data are cancelled."""
    lost = w.late_scores.groupBy(F.col("round_id").alias("id")).agg(F.avg((F.col("evaluation_status") == "insufficient_data").cast("double")).alias("p"))
    return upsert.cancel_rounds(w.rounds, lost.filter("p > 0.25").select("id")).select("id", "is_cancelled")


@query
def update_round_times(w: World) -> DataFrame:
    """Start and end moved to the first and last forecast instants."""
    seen = w.forecasts.groupBy(F.col("round_id").alias("id")).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return upsert.update_round_times(w.rounds, seen).select("id", "start_time", "end_time")


@query
def create_rounds_if_absent(w: World) -> DataFrame:
    """Of two runs of the calendar only names that the first half lacks are added, once each."""
    twice = w.created.unionByName(w.created.withColumns({"id": F.col("id") + 5000, "created_at": shift(F.col("created_at"), 60)}))
    stored = w.created.filter(F.col("registration_start") < instant(datetime(2024, 1, 18)))
    return upsert.create_rounds_if_absent(stored, twice).select("id", "name", "created_at")


def _parts(w: World) -> DataFrame:
    return w.table("part").select(
        F.col("p_partkey").alias("series_id"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("unique_id"), "p_size",
        F.col("p_name").alias("name"), F.col("p_brand").alias("description"), (F.col("p_size") * 60).cast("long").alias("frequency_s"),
        F.lit("piece").alias("unit"), F.lit("1 day").alias("update_frequency"), F.lit(None).cast("string").alias("imputation_policy"),
        F.col("p_type").alias("domain"), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("").alias("category"),
        F.when(F.col("p_retailprice") > 950, F.lit("dear")).alias("subcategory"),
    )


def _known_categories(w: World) -> DataFrame:
    """Categories of the small parts, numbered by their names."""
    keys = _parts(w).filter(F.col("p_size") <= 20).select("domain", F.nullif("category", F.lit("")).alias("category"), "subcategory").distinct()
    number = F.length("domain") * 10_000 + F.length(F.coalesce("category", F.lit(""))) * 100 + F.ascii(F.coalesce("subcategory", F.lit("-")))
    return keys.withColumn("id", number.cast("long"))


CATALOGUE = ["series_id", "unique_id", "name", "description", "frequency_s", "unit", "update_frequency", "imputation_policy", "category_id"]


@query
def resolve_categories(w: World) -> DataFrame:
    resolved, _ = upsert.resolve_categories(_known_categories(w).groupBy("domain", "category", "subcategory").agg(F.min("id").alias("id")), _parts(w))
    return resolved.select("unique_id", "domain", "category", "subcategory", "category_id")


@query
def added_categories(w: World) -> DataFrame:
    return upsert.resolve_categories(_known_categories(w), _parts(w))[1]


@query
def upsert_catalogue(w: World) -> DataFrame:
    """Parts up to size 25 are stored under other numbers; every part is written with its new attributes."""
    resolved, _ = upsert.resolve_categories(_known_categories(w), _parts(w))
    rows = resolved.select(*CATALOGUE)
    stored = rows.join(_parts(w).filter(F.col("p_size") <= 25).select("unique_id"), "unique_id", "left_semi").select(*CATALOGUE).withColumns({
        "series_id": F.col("series_id") + 7_000_000, "name": F.lit("old"), "category_id": F.lit(None).cast("long")
    })
    return upsert.upsert_catalogue(stored, rows)


@query
def update_timezone(w: World) -> DataFrame:
    zones = w.table("customer").select(
        F.col("c_name").alias("unique_id"), F.when(F.col("c_nationkey") % 3 == 0, "Europe/Berlin").when(F.col("c_nationkey") % 3 == 1, "UTC").alias("ts_timezone")
    )
    stored = zones.select("unique_id", F.when(F.col("unique_id").endswith("7"), "UTC").alias("ts_timezone"))
    return upsert.update_timezone(stored, zones)


@query
def upsert_definitions(w: World) -> DataFrame:
    """Nations as definitions; customers' balances rewrite their context length."""
    stored = w.table("nation").select(
        F.col("n_nationkey").alias("id"), F.concat(F.lit("s-"), "n_name").alias("schedule_id"), F.col("n_name").alias("name"),
        F.lit(100).cast("long").alias("context_length"), F.lit(True).alias("is_active"),
    )
    counts = w.table("customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("context_length"))
    rows = counts.select(F.concat(F.lit("s-NATION_"), F.col("id").cast("string")).alias("schedule_id"), "context_length")
    return upsert.upsert_definitions(stored, rows)


@query
def register_models(w: World) -> DataFrame:
    """Orders ask for a model named by their priority; finished orders have registered theirs already."""
    orders = w.table("orders")
    requests = orders.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") == "P", F.lit(99)).alias("organization_id"), F.struct("o_orderdate", "o_orderkey").alias("requested_at"),
    )
    users = w.table("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("organization_id"), F.when(F.col("c_mktsegment") == "BUILDING", "internal").alias("user_type")
    )
    stored = orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("name")).distinct()
    return upsert.register_models(stored, users, requests).select("user_id", "name", "organization_id", F.col("requested_at.o_orderkey").alias("order_key"))
