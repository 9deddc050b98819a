"""Price events to a regular grid."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forescale.functions.times import floor_to, instant, shift
from forescale.operators.ordered import neighbour, unroll

STEP_S = 600
DIGITS = 4


def resample_events(
    events: DataFrame, start: datetime | str, end: datetime | str, keys: Sequence[str] = ("station", "fuel"), step_s: int = STEP_S
) -> DataFrame:
    """Price per key and bin of [start, end): the carry-in, or its plain mean with the changes inside the bin.

    An event on the bin's first instant is the carry-in; repeats of the price before are no
    change. Bins before the first price are left out.

    Changes are found against the neighbour before, in bounded chunks. Each bin then gives one
    row, and the windows over a whole key see those rows alone, at most one per step of the
    calendar. Empty bins are unrolled between two filled ones, so no grid is joined.
    """
    keys = list(keys)
    priced = events.filter(F.col("price").isNotNull() & F.col("ts").isNotNull()).select(*keys, "ts", "price")
    linked = neighbour(priced, keys, "ts", {"_prev": "price"}).withColumn("bin", floor_to(F.col("ts"), step_s))
    on_grid = F.col("ts") == F.col("bin")
    entered = ~on_grid & (F.col("_prev").isNull() | (F.col("price") != F.col("_prev")))
    bins = linked.groupBy(*keys, "bin").agg(
        F.max(F.when(on_grid, F.col("price"))).alias("_start"), F.max_by("price", "ts").alias("_price"),
        F.coalesce(F.sum(F.when(entered, F.col("price"))), F.lit(0.0)).alias("_sum"), F.count_if(entered).alias("_n"),
    )
    by_bin = W.partitionBy(*keys).orderBy("bin")
    linked_bins = bins.withColumns({"_before": F.lag("_price").over(by_bin), "_next": F.lead("bin").over(by_bin)})
    carry = F.coalesce("_start", "_before")
    total = F.coalesce(carry, F.lit(0.0)) + F.col("_sum")
    count = F.when(carry.isNotNull(), 1).otherwise(0) + F.col("_n")
    mean = total / F.nullif(count, F.lit(0))
    stop = F.least(F.coalesce(F.col("_next"), instant(end)), instant(end))
    steps = F.floor((F.unix_micros(stop) - F.unix_micros("bin") - 1) / (step_s * 1_000_000)).cast("long")
    filled = linked_bins.withColumns({"_mean": mean, "_steps": steps}).filter("_steps >= 0")
    grid = unroll(filled.select(*keys, "bin", "_mean", "_price", "_steps"), F.col("_steps"), "_i")
    value = F.when(F.col("_i") == 0, F.col("_mean")).otherwise(F.col("_price"))
    return (
        grid.select(*keys, shift(F.col("bin"), F.col("_i") * step_s).alias("ts"), value.alias("price"))
        .filter((F.col("ts") >= instant(start)) & F.col("price").isNotNull())
    )


def rounded(resampled: DataFrame) -> DataFrame:
    return resampled.withColumn("price", F.round("price", DIGITS))


def step_mean(resampled: DataFrame, keys: Sequence[str] = ("fuel",)) -> DataFrame:
    """Mean over stations per step. Summed as decimals, so the order of rows cannot move a half."""
    total, count = F.sum(F.col("price").cast("decimal(20,8)")).cast("double"), F.count("price")
    mean = (total / F.nullif(count, F.lit(0))).cast("decimal(38,10)")
    return resampled.groupBy(*keys, "ts").agg(F.round(mean, DIGITS).cast("double").alias("price"))
