"""Permutation-replicated Elo ratings.

A season is sequential: each match needs the ratings the match before it left. What runs side by side is scopes and
replicates. A season is shuffled once per scope and block of replicates, never once per replicate; a task derives the
orders of its replicates from a seeded hash and advances all of them together, one match each at a time. It holds one
season: a row per round and model of a scope, which the calendar bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forescale.operators.ranking import SCOPE, cumulative_stats, rank_in_scope

# Rating parameters and summary quantiles.
REPLICATES = 500
K_FACTOR = 4.0
BASE_RATING = 1000.0
SCALE = 400.0
QUANTILES = (0.025, 0.5, 0.975)

PER_TASK = 25  # replicates that one task advances together

DAY = "calculation_date"


def matches(averages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per scope, round and model: its points (win 1, draw half) against all others of the round.

    Points follow from ranks: who stands behind in ascending order is beaten, who is neither before nor behind is level.
    Scopes with one model are left out.
    """
    models = averages.groupBy(*keys, "model_id").agg(F.count(F.lit(1)).alias("_n"))
    enough = models.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).filter("_m >= 2")
    kept = _same(averages, enough, keys)
    whole = W.partitionBy(*keys, "round_id")
    before, behind = F.rank().over(whole.orderBy("avg_mase")) - 1, F.rank().over(whole.orderBy(F.desc("avg_mase"))) - 1
    level = F.count(F.lit(1)).over(whole) - 1 - F.col("_before") - F.col("_behind")
    ranked = kept.withColumns({"_before": before, "_behind": behind})
    return ranked.select(*keys, "round_id", "model_id", (F.col("_behind") + level * F.lit(0.5)).cast("double").alias("points"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows whose keys, NULL included, occur on the right."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return left.join(renamed, match, "left_semi")


def task_count(replicates: int) -> int:
    return -(-replicates // PER_TASK)


def _season(keys: Sequence[str], replicates: int, seed: int, k_factor: float, base: float):
    """All replicates of a block over one season of (round_id, model_id, points).

    It refers to nothing outside itself but numpy and pandas, so executors need no copy of this package.
    """
    scale, blocks = SCALE, task_count(replicates)

    def rate(season: pd.DataFrame) -> pd.DataFrame:
        first = season.iloc[0]
        scope = [first[k] for k in keys]
        named = ["" if k is None or k is pd.NaT or k != k else str(k) for k in scope]
        mine = np.arange(int(first["block"]), replicates, blocks)
        rounds, at = np.unique(season["round_id"].to_numpy(), return_inverse=True)
        models, model = np.unique(season["model_id"].to_numpy(), return_inverse=True)
        place = season.groupby(at).cumcount().to_numpy()
        width = int(place.max()) + 1
        present = np.full((len(rounds), width), len(models))  # a seat that stays empty
        points = np.zeros((len(rounds), width))
        present[at, place], points[at, place] = model, season["points"].to_numpy()
        order = np.array([
            sorted(range(len(rounds)), key=lambda i: (hashlib.md5(":".join([str(seed), *named, str(r), str(rounds[i])]).encode()).hexdigest(), rounds[i])) for r in mine
        ]).reshape(len(mine), len(rounds))
        ratings = np.full((len(mine), len(models) + 1), base)
        rows = np.arange(len(mine))[:, None]
        for step in range(len(rounds)):
            seats = present[order[:, step]]
            taken = seats < len(models)
            now = ratings[rows, seats]
            expected = np.zeros_like(now)
            for other in range(width):  # against one seat at a time: memory for one match per replicate
                share = 1.0 / (1.0 + 10.0 ** ((now[:, [other]] - now) / scale))
                share[:, other] = 0.0
                expected += share * taken[:, [other]]
            gain = k_factor * (points[order[:, step]] - expected) * taken
            ratings[rows, seats] = now + np.where(taken.sum(1, keepdims=True) > 1, gain, 0.0)
        size = len(mine) * len(models)
        out = {k: pd.Series([v] * size, dtype=object) for k, v in zip(keys, scope)}
        return pd.DataFrame({**out, "replicate": np.repeat(mine, len(models)).astype("int32"), "model_id": np.tile(models, len(mine)).astype("int32"), "rating": ratings[:, :-1].reshape(-1)})

    return rate


def replicate_ratings(
    season: DataFrame, keys: Sequence[str], replicates: int = REPLICATES, seed: int = 42,
    k_factor: float = K_FACTOR, base: float = BASE_RATING,
) -> DataFrame:
    """Final rating of every model in every replicate of every scope."""
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in season.schema.fields}
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "replicate int", "model_id int", "rating double"])
    blocks = F.explode(F.sequence(F.lit(0), F.lit(task_count(replicates) - 1)))
    return season.withColumn("block", blocks).groupBy(*keys, "block").applyInPandas(_season(keys, replicates, seed, k_factor, base), schema)


def summarise(ratings: DataFrame, averages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median and 95 percent interval over replicates, and the number of rounds with a score."""
    keys = list(keys)
    spread = F.percentile("rating", F.array(*[F.lit(q) for q in QUANTILES]))
    summary = ratings.groupBy(*keys, "model_id").agg(spread.alias("_q"), F.count(F.lit(1)).cast("int").alias("n_bootstraps"))
    played = averages.groupBy(*keys, "model_id").agg(F.count(F.lit(1)).alias("matches_played"))
    renamed = played.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "model_id"]], "matches_played")
    match = F.lit(True)
    for key in [*keys, "model_id"]:
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return summary.join(renamed, match).select(
        *keys, "model_id", F.col("_q")[1].alias("elo_rating_median"), F.col("_q")[0].alias("elo_ci_lower"),
        F.col("_q")[2].alias("elo_ci_upper"), "matches_played", "n_bootstraps",
    )


def elo_ratings(averages: DataFrame, keys: Sequence[str] = tuple(SCOPE), replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Ratings of every scope in one job."""
    season = matches(averages, keys)
    return summarise(replicate_ratings(season, keys, replicates, seed), averages, keys)


def daily_rankings(
    averages: DataFrame, sums: DataFrame, rounds: DataFrame, dates: Sequence[date], replicates: int = REPLICATES, seed: int = 42
) -> DataFrame:
    """Rating snapshots of all scopes for the given dates, with cumulative statistics and ranks.

    A date rates the rounds registered by then. Dates are just another key of the scope, so any
    number of them runs in the same job.
    """
    keys = [DAY, *SCOPE]
    begun = rounds.select(F.col("id").alias("round_id"), F.to_date("registration_start").alias("_day"))
    days = F.array(*[F.lit(d) for d in dates])
    dated = averages.join(begun, "round_id").select(
        F.explode(F.filter(days, lambda d: d >= F.col("_day"))).alias(DAY), *averages.columns
    )
    rated = rank_in_scope(elo_ratings(dated, keys, replicates, seed), keys)
    stats = cumulative_stats(sums, dates)
    old = [*keys, "model_id"]
    renamed = stats.select(*[F.col(k).alias(f"_k_{k}") for k in old], "avg_mase", "mase_std", "avg_rmse", "evaluated_count")
    match = F.lit(True)
    for key in old:
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return rated.join(renamed, match, "left").drop(*[f"_k_{k}" for k in old]).withColumn(
        "evaluated_count", F.coalesce("evaluated_count", F.lit(0).cast("long"))
    )
