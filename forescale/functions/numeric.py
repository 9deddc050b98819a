"""Error measures and clean-up of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# Two averages that differ only by summation order count as equal from this digit on.
TIE_DIGITS = 9


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(INF))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def tie_key(value: Column) -> Column:
    """Sort key under which averages of the same numbers tie; infinity and NULL pass through."""
    return F.when(is_finite(value), F.round(value, TIE_DIGITS)).otherwise(value)


def stored_mase(model_error: Column, naive_error: Column) -> Column:
    """Scaled error of a stored score: both exact 0, only the baseline exact infinite."""
    return (
        F.when(naive_error > 0, model_error / F.nullif(naive_error, F.lit(0.0)))
        .when((naive_error == 0) & (model_error == 0), F.lit(0.0))
        .when(naive_error == 0, F.lit(INF))
    )


def live_mase(model_error_sum: Column, naive_error_sum: Column, n: Column) -> Column:
    """Scaled error of a running round: NULL without points or with an exact baseline."""
    return F.when((n > 0) & (naive_error_sum != 0), model_error_sum / F.nullif(naive_error_sum, F.lit(0.0)))


def spread(total: Column, total_sq: Column, n: Column) -> Column:
    """Population deviation from mergeable sums; NULL for one value or no variance."""
    count = F.nullif(n, F.lit(0)).cast("double")
    mean = total / count
    variance = total_sq / count - mean * mean
    return F.when((n > 1) & (variance > 0), F.sqrt(F.greatest(variance, F.lit(0.0))))
