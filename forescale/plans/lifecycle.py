"""Steps composed of operators, each for all rounds at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from forescale.operators import rounds
from forescale.operators.availability import data_availability


def choose(
    created: DataFrame, definitions: DataFrame, assignments: DataFrame, series: DataFrame, category: DataFrame,
    points: DataFrame, as_of: datetime | str, seed: int,
) -> DataFrame:
    available = data_availability(series, category, points, as_of)
    return rounds.choose_series(created, definitions, assignments, rounds.eligible_series(definitions, available), seed)
