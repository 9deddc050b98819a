"""Named queries over the given tables."""

from forescale.plans.queries import history, rankings, rounds, scores, series, sources, streams, writes
from forescale.plans.queries.registry import QUERIES

__all__ = ["QUERIES", "history", "rankings", "rounds", "scores", "series", "sources", "streams", "writes"]
