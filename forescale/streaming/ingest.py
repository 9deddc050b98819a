"""Ingest of landed points in any order of arrival: gaps are filled, re-opened and filled anew, every change is logged.

A batch keeps three logs. ``points`` holds delivered points by day. ``edges`` holds the first and last point of each
series and day, so the neighbours of a late point are found without reading the days between. ``changes`` holds what the
batch changed of the filled series: original and imputed points that came or moved, and imputed ones that went because a
point arrived inside their gap. The current table and the history follow from the changes.

A late point meets the gap it falls into as the batches before left it: what they filled there is computed again from the
two points around, so it can be taken back without reading it, and both halves are filled. A batch reads the points of the
days it touches and the edges of the series it touches.

Of the deliveries of one point the one with the greatest ``batch_seq`` counts, whenever it arrives. One without a value
takes the point away, and the gap opens. After any batch the current rows of the history are those of one pass over all
points delivered so far, and so are the rows valid at any earlier batch's instant.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forescale.functions.times import instant
from forescale.operators.export import balanced
from forescale.operators.imputation import IMPUTED, MAX_GAP_FACTOR, ORIGINAL, unrolled
from forescale.operators.ordered import keep_one, neighbour
from forescale.streaming.log import newest, read_log, write_batch

POINTS = "series_id int, ts timestamp, value double, frequency_s long, batch_seq long, day date"
EDGES = "series_id int, day date, first struct<ts:timestamp,value:double,frequency_s:long>, last struct<ts:timestamp,value:double,frequency_s:long>"
CHANGES = "series_id int, ts timestamp, value double, quality_code short, gone boolean, at timestamp"
KEYS = ["series_id", "ts"]


def landed_points(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of landed point files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def point_of() -> Column:
    return F.struct("ts", "value", "frequency_s")


def changed_gaps(rows: DataFrame, side: str, max_gap_factor: float) -> DataFrame:
    """Imputed rows of the gaps of one side (``old`` or ``new``) that a touched instant lies in or bounds."""
    point, after = F.col(side), F.col(f"next_{side}")
    inside = F.col("touched").isNotNull() | (F.col("next_touched") <= after["ts"])
    gaps = rows.where(point.isNotNull() & after.isNotNull() & inside)
    pairs = gaps.select("series_id", f"{side}.*", after["ts"].alias("_ts"), after["value"].alias("_value"))
    return unrolled(pairs, max_gap_factor).where(F.col("quality_code") == IMPUTED)


def ingest_batch(batch: DataFrame, batch_id: int, as_of: datetime, folder: str, impute: bool = True, max_gap_factor: float = MAX_GAP_FACTOR) -> None:
    """One batch of (series_id, ts, value, frequency_s, batch_seq) into the logs below ``folder``."""
    spark = batch.sparkSession
    arrived = keep_one(batch.where(F.col("ts").isNotNull()), KEYS, ["batch_seq"]).withColumn("day", F.to_date("ts"))
    arrived = arrived.select(*[f.split()[0] for f in POINTS.split(", ")]).persist()
    days = [r.day for r in arrived.select("day").distinct().collect()]  # bounded by the calendar
    touched_days = arrived.select("series_id", "day").distinct()

    earlier = read_log(spark, f"{folder}/points", POINTS, batch_id).where(F.col("day").isin(days))
    stored = newest(earlier.join(touched_days, ["series_id", "day"], "left_semi"), KEYS)
    newer = arrived.join(stored.select(*KEYS, F.col("batch_seq").alias("_seq")), KEYS, "left").where(F.col("_seq").isNull() | (F.col("batch_seq") >= F.col("_seq"))).drop("_seq")
    write_batch(balanced(newer, "day"), f"{folder}/points", batch_id, "day")
    newer = spark.read.schema(newer.schema).parquet(f"{folder}/points/batch={batch_id}")

    has_value = F.col("value").isNotNull()
    old = stored.where(has_value).select(*KEYS, point_of().alias("old"))
    new = newer.select(*KEYS, F.col("ts").alias("touched"), F.when(has_value, point_of()).alias("new"))
    near = old.join(new, KEYS, "full_outer").withColumn("new", F.when(F.col("touched").isNull(), F.col("old")).otherwise(F.col("new")))
    near = near.withColumn("day", F.to_date("ts"))

    edges = newest(read_log(spark, f"{folder}/edges", EDGES, batch_id).join(arrived.select("series_id").distinct(), "series_id", "left_semi"), ["series_id", "day"])
    far = edges.join(touched_days, ["series_id", "day"], "left_anti").select("series_id", F.explode(F.array_distinct(F.array("first", "last"))).alias("old"))
    far = far.where("old.ts is not null").select("series_id", "old.ts", "old", F.lit(None).cast("timestamp").alias("touched"), F.col("old").alias("new"))

    known = near.drop("day").unionByName(far)
    linked = neighbour(known, ["series_id"], "ts", {"next_old": "old", "next_new": "new", "next_touched": "touched"}, after=True, known=True)
    linked = linked.persist()
    originals = newer.where(has_value).select(*KEYS, "value", F.lit(ORIGINAL).cast("short").alias("quality_code"))
    if impute:
        fresh = originals.unionByName(changed_gaps(linked, "new", max_gap_factor))
        before = changed_gaps(linked, "old", max_gap_factor).select(*KEYS)
    else:
        fresh, before = originals, originals.select(*KEYS).limit(0)
    lost = before.unionByName(newer.where(~has_value).join(stored.where(has_value).select(*KEYS), KEYS, "left_semi").select(*KEYS))
    lost = lost.join(fresh.select(*KEYS), KEYS, "left_anti").select(*KEYS, F.lit(None).cast("double").alias("value"), F.lit(None).cast("short").alias("quality_code"), F.lit(True).alias("gone"))
    changes = fresh.withColumn("gone", F.lit(False)).unionByName(lost)
    write_batch(changes.withColumn("at", instant(as_of)), f"{folder}/changes", batch_id)

    ends = near.join(touched_days, ["series_id", "day"], "left_semi").groupBy("series_id", "day").agg(
        F.min_by("new", F.when(F.col("new").isNotNull(), F.col("ts"))).alias("first"), F.max_by("new", F.when(F.col("new").isNotNull(), F.col("ts"))).alias("last")
    )
    write_batch(ends, f"{folder}/edges", batch_id)
    linked.unpersist()
    arrived.unpersist()


def current_points(spark: SparkSession, folder: str) -> DataFrame:
    """series_id, ts, value, updated_at of the filled series; markers go to the history only."""
    state = newest(read_log(spark, f"{folder}/changes", CHANGES), KEYS)
    return state.where(~F.col("gone") & F.col("value").isNotNull()).select(*KEYS, "value", F.col("at").alias("updated_at"))


def point_history(spark: SparkSession, folder: str) -> DataFrame:
    """All versions from the change log: equal neighbours are one version, one that was never valid is none.

    The window holds the changes of one point.
    """
    order = W.partitionBy(*KEYS).orderBy("batch")
    state = F.struct("gone", "value", "quality_code")
    log = read_log(spark, f"{folder}/changes", CHANGES)
    told = log.withColumn("_next", F.lead("at").over(order)).where(F.col("_next").isNull() | (F.col("_next") > F.col("at")))  # the last of one instant
    moved = told.withColumn("_before", F.lag(state).over(order)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state))
    versions = moved.withColumn("valid_to", F.lead("at").over(order)).where(~F.col("gone"))
    return versions.select(*KEYS, "value", "quality_code", F.col("at").alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"))


def run_ingest(points: DataFrame, clock: Callable[[int], datetime], folder: str, checkpoint: str, impute: bool = True) -> StreamingQuery:
    """Polled ingest as a stream; ``clock`` gives the system time of a batch, the same on a retry."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, clock(batch_id), folder, impute)

    return points.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
