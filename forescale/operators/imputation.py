"""Gap filling of point series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.functions.times import shift
from forescale.operators.ordered import CHUNKS, next_row, unroll

# Quality codes.
ORIGINAL = 0
IMPUTED = 1

MAX_GAP_FACTOR = 6


def impute_gaps(
    points: DataFrame, max_gap_factor: float = MAX_GAP_FACTOR, enabled: bool = True, method: str = "linear",
    chunks: Sequence[str] = CHUNKS,
) -> DataFrame:
    """Points with ``frequency_s`` plus filled gaps, as (series_id, ts, value, quality_code).

    Up to 1.5 steps is no gap. Gaps up to ``max_gap_factor`` steps are interpolated by step, wider
    ones get NULL markers. Instants count in whole microseconds, so the comparisons are exact.
    A step of 0 fills nothing. A series with fewer than two points passes through, rows with a missing value included.
    """
    columns = ["series_id", "ts", "value"]
    original = F.lit(ORIGINAL).cast("short")
    if not enabled:
        return points.select(*columns, original.alias("quality_code"))
    if method != "linear":
        raise ValueError(f"unknown imputation method: {method}")
    clean = points.filter(F.col("ts").isNotNull() & F.col("value").isNotNull())
    pairs = next_row(clean.select(*columns, "frequency_s"), ["series_id"], "ts", {"_ts": "ts", "_value": "value"}, chunks)
    filled = unrolled(pairs, max_gap_factor)
    blanks = points.filter(F.col("ts").isNull() | F.col("value").isNull())
    suspects = points.join(blanks.select("series_id").distinct(), "series_id", "left_semi")
    sizes = suspects.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n < 2")
    alone = blanks.join(sizes.select("series_id"), "series_id", "left_semi").select(*columns, original.alias("quality_code"))
    return filled.unionByName(alone)


def unrolled(pairs: DataFrame, max_gap_factor: float = MAX_GAP_FACTOR) -> DataFrame:
    """Each point (series_id, ts, value, frequency_s) and what fills the gap to the next one (_ts, _value), if any."""
    gap = F.unix_micros("_ts") - F.unix_micros("ts")
    step = F.col("frequency_s").cast("long") * 1_000_000
    missing = F.floor(gap / F.nullif(step, F.lit(0))).cast("long") - 1
    opened = pairs.withColumns({"_gap": gap, "_step": step}).withColumn(
        "_n", F.when(2 * F.col("_gap") > 3 * F.col("_step"), F.greatest(missing, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    )
    rows = unroll(opened, F.col("_n"), "_i")
    between = F.col("value") + (F.col("_value") - F.col("value")) * (F.col("_i") / (F.col("_n") + 1))
    wide = F.col("_gap") > F.col("_step") * max_gap_factor
    first = F.col("_i") == 0
    return rows.select(
        "series_id",
        F.when(first, F.col("ts")).otherwise(shift(F.col("ts"), F.col("_i") * F.col("frequency_s"))).alias("ts"),
        F.when(first, F.col("value")).when(~wide, between).alias("value"),
        F.when(first, F.lit(ORIGINAL)).otherwise(F.lit(IMPUTED)).cast("short").alias("quality_code"),
    )


def imputation_counts(imputed: DataFrame) -> DataFrame:
    """Interpolated values and NULL markers per series."""
    added = F.col("quality_code") == IMPUTED
    return imputed.groupBy("series_id").agg(
        F.count_if(~added).alias("original_count"),
        F.count_if(added & F.col("value").isNotNull()).alias("interpolated_count"),
        F.count_if(added & F.col("value").isNull()).alias("null_marker_count"),
    )


def operational(imputed: DataFrame) -> DataFrame:
    """Rows for the current table; markers go to the history only."""
    return imputed.filter(F.col("value").isNotNull())
