"""Forecast-benchmark analytics on Spark DataFrames."""

from forescale.session import configure, shared_dir

__all__ = ["configure", "shared_dir"]
