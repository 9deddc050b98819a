"""Ranking base, round sums, cumulative statistics, rating snapshots and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forescale.functions.durations import scope_id
from forescale.functions.numeric import TIE_DIGITS, finite_or_null, is_finite, spread
from forescale.functions.times import instant, is_month_end, shift
from forescale.operators.scoring import without_excluded

# Label and length in days of the ranking windows.
RANGES = {"Last 7 days": 7, "Last 30 days": 30, "Last 90 days": 90, "Last 365 days": 365}

SCOPE = ["scope_type", "scope_id"]


def valid_scores(scores: DataFrame, rounds: DataFrame, assignments: DataFrame) -> DataFrame:
    """Final scores with a finite error, without excluded series, with definition_id."""
    kept = scores.filter(F.col("final_evaluation") & is_finite(F.col("mase")))
    return without_excluded(kept, rounds, assignments)


def ranking_base(
    scores: DataFrame, rounds: DataFrame, definitions: DataFrame, assignments: DataFrame, models: DataFrame,
    users: DataFrame, series: DataFrame, category: DataFrame,
) -> DataFrame:
    """Valid scores with every dimension a ranking can filter on; inactive definitions show as NULL."""
    windows = rounds.select(
        F.col("id").alias("round_id"), F.col("name").alias("round_name"), "horizon_s",
        F.col("end_time").alias("round_end_time"), F.col("start_time").alias("round_start_time"),
    )
    active = definitions.filter("is_active").select(
        F.col("id").alias("definition_id"), F.col("name").alias("definition_name"), F.col("domains").alias("definition_domains")
    )
    who = models.join(users.select(F.col("id").alias("user_id"), "username"), "user_id").select(
        F.col("id").alias("model_id"), F.col("name").alias("model_name"), "username"
    )
    what = series.select("series_id", F.col("name").alias("series_name"), "frequency_s", "unique_id", "category_id")
    kind = category.select(F.col("id").alias("category_id"), "domain", "category", "subcategory")
    return (
        valid_scores(scores, rounds, assignments)
        .join(windows, "round_id").join(active, "definition_id", "left").join(who, "model_id")
        .join(what, "series_id").join(kind, "category_id", "left").drop("category_id")
    )


def with_scopes(rows: DataFrame, definitions: DataFrame, keep_loose: bool = True) -> DataFrame:
    """Each row once per scope: global, its definition, and its definition's frequency and horizon.

    Scopes are unrolled in place, so the table is scanned once instead of once per scope. A
    round without a definition has no frequency scope; its definition scope has a NULL id.
    """
    scope_type = "struct<scope_type:string,scope_id:string>"
    pair = definitions.select(
        F.col("id").alias("definition_id"), scope_id(F.col("frequency_s"), F.col("horizon_s")).alias("_fh"), F.lit(True).alias("_known")
    )
    everything = F.struct(F.lit("global").alias("scope_type"), F.lit(None).cast("string").alias("scope_id"))
    own = F.struct(F.lit("definition").alias("scope_type"), F.col("definition_id").cast("string").alias("scope_id"))
    if not keep_loose:
        own = F.when(F.col("definition_id").isNotNull(), own)
    grouped = F.when(
        F.col("_known") & F.col("_fh").isNotNull(), F.struct(F.lit("frequency_horizon").alias("scope_type"), F.col("_fh").alias("scope_id"))
    )
    scopes = F.array_compact(F.array(*[s.cast(scope_type) for s in (everything, own, grouped)]))
    return rows.join(pair, "definition_id", "left").select(*rows.columns, F.explode(scopes).alias("_s")).select(*rows.columns, "_s.*")


def round_model_scores(scores: DataFrame, rounds: DataFrame, definitions: DataFrame, assignments: DataFrame) -> DataFrame:
    """Mergeable sums per round, model and scope.

    The sums are built per (round, model) first; scopes are unrolled on that small table.
    """
    dates = rounds.select(F.col("id").alias("round_id"), F.to_date("registration_start").alias("round_date"))
    mase = F.col("mase")
    sums = valid_scores(scores, rounds, assignments).groupBy("round_id", "definition_id", "model_id").agg(
        F.sum(mase).alias("sum_mase"), F.sum(mase * mase).alias("sum_mase_sq"),
        F.sum("rmse").alias("sum_rmse"), F.count(F.lit(1)).alias("num_scores"),
    )
    return with_scopes(sums.join(dates, "round_id"), definitions).select(
        "round_id", "round_date", "model_id", *SCOPE, "sum_mase", "sum_mase_sq", "sum_rmse", "num_scores"
    )


def refresh_round_sums(old: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Old sums of untouched rounds with newly computed sums of the touched ones."""
    rounds = touched.select("round_id").distinct()
    return old.join(rounds, "round_id", "left_anti").unionByName(fresh.join(rounds, "round_id", "left_semi"))


IMAGE = ["mase", "rmse", "final_evaluation"]


def score_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Images ``old`` and ``new`` of every score that came, went or differs between two states."""
    keys = ["round_id", "model_id", "series_id"]
    image = F.struct(*IMAGE)
    both = before.select(*keys, image.alias("old")).join(after.select(*keys, image.alias("new")), keys, "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def sum_deltas(changes: DataFrame, rounds: DataFrame, definitions: DataFrame, assignments: DataFrame) -> DataFrame:
    """What changed scores add to the sums per round, model and scope: the new image counts, the old one is taken off.

    An image that is not final or has no finite error counts nothing, so a score that turns invalid leaves the sums.
    """
    images = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("image")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("image")))
    rows = changes.select("round_id", "model_id", "series_id", F.explode(images).alias("i")).where("i.image is not null")
    valid = valid_scores(rows.select("round_id", "model_id", "series_id", "i.sign", "i.image.*"), rounds, assignments)
    dates = rounds.select(F.col("id").alias("round_id"), F.to_date("registration_start").alias("round_date"))
    mase, sign = F.col("mase"), F.col("sign")
    sums = valid.groupBy("round_id", "definition_id", "model_id").agg(
        F.sum(sign * mase).alias("sum_mase"), F.sum(sign * mase * mase).alias("sum_mase_sq"),
        F.sum(sign * F.col("rmse")).alias("sum_rmse"), F.sum(sign).alias("num_scores"),
    )
    return with_scopes(sums.join(dates, "round_id"), definitions).select(
        "round_id", "round_date", "model_id", *SCOPE, "sum_mase", "sum_mase_sq", "sum_rmse", "num_scores"
    )


def merged_sums(deltas: DataFrame) -> DataFrame:
    """Sums per round, model and scope from any number of logged deltas; what no score is left of is gone."""
    values = ["sum_mase", "sum_mase_sq", "sum_rmse", "num_scores"]
    return deltas.groupBy("round_id", "round_date", "model_id", *SCOPE).agg(*[F.sum(v).alias(v) for v in values]).where("num_scores > 0")


def cumulative_stats(sums: DataFrame, dates: Sequence[date]) -> DataFrame:
    """Mean, population deviation and count per model and scope up to each date, from the sums."""
    days = F.array(*[F.lit(d) for d in dates])
    reached = sums.select("*", F.explode(F.filter(days, lambda d: d >= F.col("round_date"))).alias("calculation_date"))
    total = reached.groupBy("calculation_date", "model_id", *SCOPE).agg(
        F.sum("sum_mase").alias("_m"), F.sum("sum_mase_sq").alias("_q"), F.sum("sum_rmse").alias("_r"),
        F.sum("num_scores").alias("evaluated_count"),
    )
    n = F.col("evaluated_count")
    return total.select(
        "calculation_date", "model_id", *SCOPE, (F.col("_m") / n).alias("avg_mase"),
        spread(F.col("_m"), F.col("_q"), n).alias("mase_std"), (F.col("_r") / n).alias("avg_rmse"), "evaluated_count",
    )


def round_averages(scores: DataFrame, rounds: DataFrame, definitions: DataFrame, assignments: DataFrame) -> DataFrame:
    """Average error per scope, round and model: the matches of a rating season.

    Averages are cut to nine digits, so that summation order cannot decide a match.
    """
    averages = valid_scores(scores, rounds, assignments).groupBy("round_id", "definition_id", "model_id").agg(
        F.round(F.avg("mase"), TIE_DIGITS).alias("avg_mase")
    )
    return with_scopes(averages, definitions, keep_loose=False).select(*SCOPE, "round_id", "model_id", "avg_mase")


def rated_definitions(scores: DataFrame, rounds: DataFrame) -> DataFrame:
    """Definitions with any final score."""
    final = scores.filter(F.col("final_evaluation") & F.col("mase").isNotNull()).select("round_id").distinct()
    return rounds.join(final, rounds["id"] == final["round_id"], "left_semi").filter(
        F.col("definition_id").isNotNull()
    ).select("definition_id").distinct()


def rated_groups(scores: DataFrame, rounds: DataFrame, definitions: DataFrame) -> DataFrame:
    """Frequency and horizon pairs with any final score."""
    rated = rated_definitions(scores, rounds)
    return definitions.join(rated, definitions["id"] == rated["definition_id"], "left_semi").filter(
        F.col("frequency_s").isNotNull() & F.col("horizon_s").isNotNull()
    ).select("frequency_s", "horizon_s", scope_id(F.col("frequency_s"), F.col("horizon_s")).alias("scope_id")).distinct()


def window_rankings(scores: DataFrame, rounds: DataFrame, models: DataFrame, users: DataFrame, as_of: datetime | str) -> DataFrame:
    """Count and mean error per model for rounds that ended in the last 7, 30, 90 and 365 days.

    Scores merge per (round, model) before the ranges are unrolled.
    """
    ends = rounds.select(F.col("id").alias("round_id"), "end_time")
    who = models.join(users.select(F.col("id").alias("user_id")), "user_id").select(F.col("id").alias("model_id"), F.col("name").alias("model_name"))
    ranges = F.array(*[
        F.struct(F.lit(label).alias("range_label"), shift(instant(as_of), -days * 86400).alias("since")) for label, days in RANGES.items()
    ])
    per_round = scores.filter(F.col("mase").isNotNull()).groupBy("round_id", "model_id").agg(
        F.sum("mase").alias("_m"), F.count(F.lit(1)).alias("_n")
    )
    return (
        per_round.join(ends, "round_id").join(who, "model_id")
        .select("model_name", "_m", "_n", F.explode(F.filter(ranges, lambda r: F.col("end_time") >= r["since"])).alias("r"))
        .groupBy(F.col("r.range_label").alias("range_label"), "model_name")
        .agg(F.sum("_n").alias("n_completed"), (F.sum("_m") / F.sum("_n")).alias("_avg"))
        .select("range_label", "model_name", "n_completed", finite_or_null(F.col("_avg")).alias("avg_mase"))
        .orderBy("range_label", F.asc_nulls_last("avg_mase"), F.desc("n_completed"), "model_name")
    )


def model_details(models: DataFrame, scores: DataFrame) -> DataFrame:
    """Rounds taken part in and forecasts made per model; scores merge per (model, round) first."""
    per_round = scores.groupBy("model_id", "round_id").agg(F.sum("forecast_count").alias("_n"))
    totals = per_round.groupBy(F.col("model_id").alias("id")).agg(
        F.count(F.lit(1)).alias("challenges_participated"), F.sum("_n").alias("forecasts_made")
    )
    none = F.lit(0).cast("long")
    return models.join(totals, "id", "left").withColumns({
        "challenges_participated": F.coalesce("challenges_participated", none),
        "forecasts_made": F.coalesce("forecasts_made", none),
    })


def series_by_definition(base: DataFrame) -> DataFrame:
    """Rounds per model, definition and series, from the ranking base."""
    keys = ["model_id", "definition_id", "definition_name", "series_id", "series_name", "unique_id"]
    return base.select(*keys, "round_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("rounds_participated"))


def leaderboard(rankings: DataFrame, models: DataFrame, users: DataFrame, organisations: DataFrame, definitions: DataFrame) -> DataFrame:
    """Snapshots with model, owner and definition, and whether they are their scope's newest."""
    newest = rankings.groupBy(*SCOPE).agg(F.max("calculation_date").alias("_newest"))
    pick = newest.select(F.col("scope_type").alias("_t"), F.col("scope_id").alias("_i"), "_newest")
    who = (
        models.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
        .join(organisations.select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name")), "organization_id", "left")
        .select(F.col("id").alias("model_id"), F.col("name").alias("model_name"), "readable_id", "model_family",
                "model_type", "architecture", "model_size", "username", "organization_name")
    )
    of = definitions.select(
        F.lit("definition").alias("_dt"), F.col("id").cast("string").alias("_di"), F.col("id").alias("definition_id"),
        F.col("name").alias("definition_name"), F.col("schedule_id").alias("definition_schedule_id"),
    )
    same_scope = (F.col("scope_type") == F.col("_t")) & F.col("scope_id").eqNullSafe(F.col("_i"))
    return (
        rankings.join(pick, same_scope).withColumn("is_latest", F.col("calculation_date") == F.col("_newest")).drop("_t", "_i", "_newest")
        .join(who, "model_id")
        .join(of, (F.col("scope_type") == F.col("_dt")) & (F.col("scope_id") == F.col("_di")), "left").drop("_dt", "_di")
    )


def leaderboard_order() -> list:
    return [F.desc("calculation_date"), F.asc("scope_type"), F.asc_nulls_first("scope_id"), F.desc("elo_rating_median"), F.asc("model_id")]


def monthly_and_latest(board: DataFrame) -> DataFrame:
    """Newest snapshots and those of a month's last day."""
    month_end = is_month_end(F.col("calculation_date"))
    return board.filter(F.col("is_latest") | month_end).withColumn("is_month_end", month_end)


def top_models(board: DataFrame, scope_type: str, scope: str | None = None, day: date | None = None, k: int = 50) -> DataFrame:
    """Best ``k`` ratings of a scope on a date, or on the scope's newest date."""
    kept = board.filter((F.col("scope_type") == scope_type) & F.col("scope_id").eqNullSafe(F.lit(scope)))
    kept = kept.filter(F.col("is_latest")) if day is None else kept.filter(F.col("calculation_date") == F.lit(day))
    return kept.orderBy(F.desc("elo_rating_median"), "model_id").limit(k)


def filtered_rankings(
    monthly: DataFrame, scope_type: str | None = None, scope: str | int | None = None, day: date | None = None, k: int = 100
) -> DataFrame:
    """Rankings by rank for one scope (a definition id, or a frequency and horizon key), newest or of a date."""
    kept = monthly.filter("is_latest") if day is None else monthly.filter(F.col("calculation_date") == F.lit(day))
    if scope_type is not None:
        kept = kept.filter(F.col("scope_type") == scope_type)
        if scope_type == "definition" and scope is not None:
            kept = kept.filter(F.col("definition_id") == F.lit(scope))
        elif scope_type == "frequency_horizon" and scope is not None:
            kept = kept.filter(F.col("scope_id") == F.lit(scope))
        order = ["rank_position", "scope_id", "model_id"]
    else:
        order = ["scope_type", "scope_id", "rank_position", "model_id"]
    numbers = ["elo_rating_median", "elo_ci_lower", "elo_ci_upper", "avg_mase", "mase_std"]
    return kept.orderBy(*order).limit(k).withColumns({c: finite_or_null(F.col(c)) for c in numbers})


def ranking_filter_options(monthly: DataFrame, rankings: DataFrame, definitions: DataFrame) -> DataFrame:
    """(kind, key, label) rows: active definitions, stored frequency scopes, snapshot dates with month-end flag."""
    text = lambda c: F.col(c).cast("string")
    named = definitions.filter("is_active").select(F.lit("definition").alias("kind"), text("id").alias("key"), F.col("name").alias("label"))
    pairs = rankings.filter((F.col("scope_type") == "frequency_horizon") & F.col("scope_id").isNotNull()).select(
        F.lit("frequency_horizon").alias("kind"), F.col("scope_id").alias("key"), F.lit(None).cast("string").alias("label")
    ).distinct()
    days = monthly.select(F.lit("date").alias("kind"), text("calculation_date").alias("key"), text("is_month_end").alias("label")).distinct()
    return named.unionByName(pairs).unionByName(days)


def rating_trajectory(monthly: DataFrame) -> DataFrame:
    """Per model and scope: its snapshots in date order (one element per stored date)."""
    point = F.struct("calculation_date", F.col("elo_rating_median").alias("elo_score"), "elo_ci_lower", "elo_ci_upper", "rank_position")
    return monthly.groupBy("model_id", "model_name", *SCOPE, "definition_id", "definition_name").agg(
        F.array_sort(F.collect_list(point)).alias("daily_rankings")
    )


def has_snapshot(rankings: DataFrame, day: date) -> DataFrame:
    """One row: is there a global snapshot of the date?"""
    return rankings.agg(
        F.coalesce(F.bool_or((F.col("scope_type") == "global") & (F.col("calculation_date") == F.lit(day))), F.lit(False)).alias("has_snapshot")
    )


def rank_in_scope(ratings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position by median rating; a scope holds one row per model."""
    order = W.partitionBy(*keys).orderBy(F.desc(F.round("elo_rating_median", TIE_DIGITS)), "model_id")
    return ratings.withColumn("rank_position", F.row_number().over(order))
