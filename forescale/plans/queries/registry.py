"""Registry of named queries: name to a function of session and data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forescale.plans.world import World, world

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(world(spark, folder))

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return build


def shown(value, digits: int = 6):
    """Rounded half up from ten decimal digits, so that the last bits of a sum do not decide; infinite and NaN as NULL."""
    return F.round(value.try_cast("decimal(38,10)"), digits).cast("double")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Shown numbers; cut so that summation order does not show."""
    return df.withColumns({c: shown(F.col(c), digits) for c in columns})


def with_quantiles(df: DataFrame) -> DataFrame:
    """The lowest and highest level of the quantile map as columns."""
    level = lambda name: shown(F.try_element_at("probabilistic_values", F.lit(name)))
    return df.withColumns({"q_low": level("0.025"), "q_high": level("0.975")}).drop("probabilistic_values")


def ci_text(points):
    """Points with an interval, and the sum of their highest levels."""
    high = F.transform(F.filter(points, lambda p: p["ci"].isNotNull()), lambda p: F.try_element_at(p["ci"], F.lit("0.975")))
    return [F.size(high).alias("n_ci"), shown(F.aggregate(high, F.lit(0.0), lambda acc, v: acc + v)).alias("ci_sum")]


def points_text(points, value: str = "y"):
    """Count, ends and sum of an array of points, as flat columns."""
    total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[value])
    return [
        F.size(points).alias("n_points"), F.try_element_at(points, F.lit(1))["ts"].alias("first_ts"),
        F.try_element_at(points, F.lit(-1))["ts"].alias("last_ts"), shown(total).alias("value_sum"),
    ]
