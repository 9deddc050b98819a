"""Normalisers over payloads made from whole tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.plans import landed
from forescale.plans.queries.registry import query, rounded
from forescale.plans.world import World
from forescale.session import small_table
from forescale.sources import catalogue, payloads

WIDE_DEFS = [
    ("quantity", "l_quantity", None, None), ("quantity-a", "l_quantity", "l_returnflag", "A"), ("price", "l_extendedprice", "", ""),
    ("discount-r-o", "l_discount", "l_returnflag", "R"), ("tax-o", "l_tax", "l_linestatus", "O"), ("nothing", "l_tax", "no_such_column", "O"),
]


@query
def normalise_points(w: World) -> DataFrame:
    return payloads.extract_points(landed.point_lists(w))


@query
def normalise_wide(w: World) -> DataFrame:
    """Lineitem as a wide table; counts and sums per series and instant."""
    defs = small_table(w.spark, WIDE_DEFS, "unique_id string, value_column string, filter_column string, filter_value string")
    wide = w.table("lineitem").withColumnRenamed("l_shipdate", "Time").withColumn("Interval Start", F.col("Time"))
    rows = payloads.extract_wide(wide, defs, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"])
    return rounded(rows.groupBy("unique_id", "ts").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=2)


@query
def normalise_long(w: World) -> DataFrame:
    defs = w.events.select("event_type").distinct().filter(F.col("event_type") != "signup").select(
        F.concat(F.lit("ev-"), "event_type").alias("unique_id"), w.type_series().alias("dataset_id")
    )
    return payloads.extract_long(landed.datasets(w), defs)


@query
def normalise_single(w: World) -> DataFrame:
    rows = w.events.select(
        F.concat(F.lit("us-"), F.col("user_id").cast("string")).alias("unique_id"), landed.iso(F.col("ts")).alias("startTime"),
        landed.iso(F.col("ts")).alias("endTime"), F.col("value").alias("wind"), "event_id",
    )
    return payloads.extract_single(rows, F.col("unique_id"))


@query
def normalise_pairs(w: World) -> DataFrame:
    return payloads.extract_pairs(landed.pairs(w), datetime(2024, 1, 3), datetime(2024, 1, 27))


@query
def normalise_records(w: World) -> DataFrame:
    return payloads.extract_records(landed.records(w))


@query
def normalise_market_xml(w: World) -> DataFrame:
    return payloads.extract_market_xml(landed.market_documents(w))


@query
def normalise_garages(w: World) -> DataFrame:
    return payloads.extract_garages(landed.garage_polls(w), landed.garage_defs(w))


@query
def normalise_stations(w: World) -> DataFrame:
    return payloads.extract_stations(landed.station_polls(w), landed.station_defs(w))


@query
def normalise_live_prices(w: World) -> DataFrame:
    return payloads.extract_live_prices(landed.live_polls(w), landed.live_stations(w), landed.live_defs(w))


@query
def read_price_csv(w: World) -> DataFrame:
    folder = f"{w.stage_root}/price_csv"
    landed.price_rows(w).write.mode("overwrite").option("header", True).csv(folder)
    return payloads.read_price_csv(w.spark, folder, landed.live_stations(w))


@query
def union_slices(w: World) -> DataFrame:
    """One slice per day of the events; every second day lacks the user."""
    first, last = w.event_days
    days = [first + timedelta(days=n) for n in range((last - first).days + 1)]
    slices = [w.events.filter(F.to_date("ts") == F.lit(day)).select("event_id", "ts", "value", *["user_id"][: 1 - n % 2]) for n, day in enumerate(days)]
    return payloads.union_slices(slices)


@query
def resolve_series(w: World) -> DataFrame:
    """Points per known series; instants of one series run on under a name the catalogue lacks."""
    name = F.when(F.col("user_id") % 10 == 3, F.lit("lost-")).otherwise(F.lit("us-"))
    points = w.events.select(F.concat(name, F.col("user_id").cast("string")).alias("unique_id"), "ts", "value")
    return payloads.to_series(points, w.series)[0]


@query
def unknown_series(w: World) -> DataFrame:
    name = F.when(F.col("user_id") % 10 == 3, F.lit("lost-")).otherwise(F.lit("us-"))
    points = w.events.select(F.concat(name, F.col("user_id").cast("string")).alias("unique_id"), "ts", "value")
    return payloads.to_series(points, w.series)[1]


@query
def load_catalogue(w: World) -> DataFrame:
    return catalogue.load_catalogue(landed.catalogue_configs(w))
