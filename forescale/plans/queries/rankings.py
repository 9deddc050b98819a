"""Ranking base, statistics, ratings and leaderboards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.operators import elo, ranking
from forescale.plans.queries.registry import query, rounded
from forescale.plans.world import AS_OF, SEED, SNAPSHOTS, World

RATING = ["elo_rating_median", "elo_ci_lower", "elo_ci_upper"]
STATS = ["avg_mase", "mase_std", "avg_rmse"]


def _base(w: World) -> DataFrame:
    return ranking.ranking_base(w.late_scores, w.rounds, w.definitions, w.assignments, w.models, w.users, w.series, w.category)


@query
def ranking_base(w: World) -> DataFrame:
    names = F.concat_ws(",", "definition_domains").alias("definition_domains")
    rows = _base(w).select(
        "round_id", "model_id", "series_id", "mase", "rmse", "round_name", "round_end_time", "definition_id", "definition_name", names,
        "model_name", "username", "series_name", "unique_id", "domain", "category", "subcategory",
    )
    return rounded(rows, "mase", "rmse")


@query
def round_model_scores(w: World) -> DataFrame:
    return rounded(ranking.round_model_scores(w.late_scores, w.rounds, w.definitions, w.assignments), "sum_mase", "sum_mase_sq", "sum_rmse")


@query
def round_sums_refresh(w: World) -> DataFrame:
    """Sums of the earlier scores, refreshed for rounds that were scored again."""
    old = ranking.round_model_scores(w.scores, w.rounds, w.definitions, w.assignments)
    fresh = ranking.round_model_scores(w.late_scores, w.rounds, w.definitions, w.assignments)
    touched = w.scores.filter(~F.col("final_evaluation")).select("round_id")
    return rounded(ranking.refresh_round_sums(old, fresh, touched), "sum_mase", "sum_mase_sq", "sum_rmse")


@query
def cumulative_stats(w: World) -> DataFrame:
    return rounded(ranking.cumulative_stats(w.sums, SNAPSHOTS), *STATS)


@query
def window_rankings(w: World) -> DataFrame:
    return rounded(ranking.window_rankings(w.late_scores, w.rounds, w.models, w.users, AS_OF), "avg_mase")


@query
def model_details(w: World) -> DataFrame:
    return ranking.model_details(w.models, w.late_scores).select("id", "name", "challenges_participated", "forecasts_made")


@query
def series_by_definition(w: World) -> DataFrame:
    return ranking.series_by_definition(_base(w))


@query
def rated_definitions(w: World) -> DataFrame:
    return ranking.rated_definitions(w.scores, w.rounds)


@query
def rated_groups(w: World) -> DataFrame:
    return ranking.rated_groups(w.scores, w.rounds, w.definitions)


@query
def round_averages(w: World) -> DataFrame:
    return rounded(w.averages, "avg_mase")


@query
def elo_fixed_order(w: World) -> DataFrame:
    """Two replicates of every scope."""
    return rounded(elo.elo_ratings(w.averages, replicates=2, seed=SEED), *RATING)


@query
def elo_season(w: World) -> DataFrame:
    """Final ratings of every model in two replicates."""
    season = elo.matches(w.averages, ranking.SCOPE)
    return rounded(elo.replicate_ratings(season, ranking.SCOPE, 2, SEED), "rating")


@query
def daily_rankings(w: World) -> DataFrame:
    """Snapshots of three dates with 500 replicates per scope."""
    return rounded(elo.daily_rankings(w.averages, w.sums, w.rounds, SNAPSHOTS, seed=SEED), *RATING, *STATS)


@query
def leaderboard(w: World) -> DataFrame:
    return rounded(w.board, *RATING, *STATS).orderBy(*ranking.leaderboard_order())


@query
def leaderboard_latest(w: World) -> DataFrame:
    rows = ranking.filtered_rankings(ranking.monthly_and_latest(w.board))
    return rounded(rows.select("scope_type", "scope_id", "rank_position", "model_name", "calculation_date", *RATING), *RATING)


@query
def leaderboard_top(w: World) -> DataFrame:
    rows = ranking.top_models(w.board, "frequency_horizon", "1 day::3 days", k=3)
    return rounded(rows.select("scope_id", "rank_position", "model_name", "calculation_date", *RATING), *RATING)


@query
def rankings_of_definition(w: World) -> DataFrame:
    rows = ranking.filtered_rankings(ranking.monthly_and_latest(w.board), "definition", 4, date(2024, 1, 31))
    return rounded(rows.select("definition_id", "rank_position", "model_name", *RATING, "avg_mase"), *RATING, "avg_mase")


@query
def rating_trajectory(w: World) -> DataFrame:
    rows = ranking.rating_trajectory(w.board)
    last = F.try_element_at("daily_rankings", F.lit(-1))
    return rounded(rows.select(
        "model_id", "scope_type", "scope_id", "definition_name", F.size("daily_rankings").alias("n"),
        last["calculation_date"].alias("last_date"), last["elo_score"].alias("last_score"), last["rank_position"].alias("last_rank"),
    ), "last_score")


@query
def ranking_filter_options(w: World) -> DataFrame:
    return ranking.ranking_filter_options(ranking.monthly_and_latest(w.board), w.rankings, w.definitions)


@query
def has_snapshot(w: World) -> DataFrame:
    return ranking.has_snapshot(w.rankings, SNAPSHOTS[0])
