"""Streaming rollups and repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forescale.functions.durations import RESOLUTION_SECONDS
from forescale.operators.rollup import REFRESH_WINDOWS
from forescale.streaming.log import newest, read_log, write_batch

ROLLUP = "series_id int, ts timestamp, value double, sample_count long, min_value double, max_value double"


def rollup_stream(points: DataFrame, resolution: str) -> DataFrame:
    """Tumbling rollup; points later than the refresh horizon of the resolution are dropped.

    State is one small row per open (series, bucket) and leaves with the watermark.
    """
    width = RESOLUTION_SECONDS[resolution]
    late = REFRESH_WINDOWS[resolution][0]
    return (
        points.withWatermark("ts", f"{late} seconds")
        .groupBy("series_id", F.window("ts", f"{width} seconds"))
        .agg(
            F.avg("value").alias("value"), F.count(F.lit(1)).alias("sample_count"),
            F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        )
        .select("series_id", F.col("window.start").alias("ts"), "value", "sample_count", "min_value", "max_value")
    )


def run_rollup(points: DataFrame, resolution: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps a log of changed buckets; ``rollup_table`` reads the newest state of each."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, folder, batch_id)

    return (
        rollup_stream(points, resolution).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )


def rollup_table(spark: SparkSession, folder: str) -> DataFrame:
    return newest(read_log(spark, folder, ROLLUP), ["series_id", "ts"]).drop("batch")


def drop_repeats(events: DataFrame, keys: list[str], ts: str = "ts", within: str = "1 day") -> DataFrame:
    """A re-delivered event counts once within the horizon."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
