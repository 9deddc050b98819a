"""Normalisers: landed payloads to (unique_id, ts, value).

Each takes DataFrames and works the same on a batch and on a stream's micro-batch. Payload
columns hold one response of a source; schemas are explicit, nothing is inferred from the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forescale.functions.times import floor_to, instant, local_to_utc, read_instant, shift
from forescale.operators.ordered import keep_one

# Column precedence of wide tables, payload schemas, price rules.
TIME_COLUMNS = ("Interval End", "Time", "Interval Start")
POINT_LIST = "struct<data: array<struct<ts: string, value: double>>>"
PAIRS = "struct<series: array<array<double>>>"
RECORDS = "struct<response: struct<total: string, data: array<struct<period: string, value: string>>>>"
DATASETS = "struct<data: array<struct<datasetId: int, endTime: string, value: double>>>"
STATIONS = (
    "array<struct<free_bikes: int, empty_slots: int, "
    "extra: struct<ebike: int, ebikes: int, normal_bikes: int>>>"
)
LIVE_PRICES = "map<string, struct<status: string, e5: double, e10: double, diesel: double>>"
MARKET_XML = (
    "struct<TimeSeries: array<struct<Period: struct<timeInterval: struct<start: string>, "
    "resolution: string, Point: array<struct<position: int, quantity: double>>>>>>"
)
GARAGE_XML = "struct<parkhaus: array<struct<bezeichnung: string, gesamt: string, frei: string, status: string, zeitstempel: string>>>"
FUELS = ("e5", "e10", "diesel")
METRICS = ("free_bikes", "empty_slots", "ebikes", "normal_bikes")
TOTAL = "total"
NATIONAL = "national"
MARKET_STEPS = {"PT60M": 3600, "PT15M": 900}
OTHER_STEP_S = 60
LOCAL_ZONE = "Europe/Berlin"
MAX_PRICE = 5
PRICE_TIME = "yyyy-MM-dd HH:mm:ssX"


class Normaliser(Protocol):
    """Contract of a source: payload rows and series definitions to points."""

    def __call__(self, payloads: DataFrame, series_defs: DataFrame) -> DataFrame: ...


def _points(rows: DataFrame, unique_id: Column, ts: Column, value: Column) -> DataFrame:
    return rows.select(unique_id.alias("unique_id"), ts.alias("ts"), value.cast("double").alias("value"))


def extract_points(payloads: DataFrame) -> DataFrame:
    """``{"data": [{ts, value}]}`` per unique_id."""
    rows = payloads.select("unique_id", F.explode(F.from_json("payload", POINT_LIST)["data"]).alias("p"))
    return _points(rows, F.col("unique_id"), read_instant(F.col("p.ts")), F.col("p.value"))


def time_column(columns: Sequence[str]) -> str:
    return next((c for c in TIME_COLUMNS if c in columns), columns[0])


def extract_wide(df: DataFrame, series_defs: DataFrame, value_columns: Sequence[str], filter_columns: Sequence[str] = ()) -> DataFrame:
    """A wide table to one series per definition.

    ``series_defs`` has unique_id, value_column, filter_column and filter_value; empty filters
    take every row. Missing values stay as NULL, rows without a time are dropped.
    """
    ts = time_column(df.columns)
    tags = F.create_map(*[x for c in filter_columns for x in (F.lit(c), F.col(c).cast("string"))]) if filter_columns else F.create_map().cast("map<string,string>")
    numbers = [F.col(c).cast("double").alias(c) for c in value_columns]
    long = (
        df.select(F.col(ts).alias("_ts"), tags.alias("_tags"), *numbers)
        .filter(F.col("_ts").isNotNull())
        .unpivot(["_ts", "_tags"], list(value_columns), "value_column", "_value")
    )
    unfiltered = (F.coalesce("filter_column", F.lit("")) == "") | (F.coalesce("filter_value", F.lit("")) == "")
    matched = long.join(series_defs, "value_column").filter(
        unfiltered | F.coalesce(F.try_element_at("_tags", F.col("filter_column")) == F.col("filter_value"), F.lit(False))
    )
    value = F.when(~F.isnan("_value"), F.col("_value"))
    return _points(matched, F.col("unique_id"), F.col("_ts"), value)


def extract_long(payloads: DataFrame, series_defs: DataFrame) -> DataFrame:
    """Rows tagged with a dataset id; unmapped datasets are dropped, missing values stay as NULL."""
    rows = payloads.select(F.explode(F.from_json("payload", DATASETS)["data"]).alias("p")).select("p.*")
    mapped = rows.join(series_defs.select("unique_id", F.col("dataset_id").alias("datasetId")), "datasetId")
    return _points(mapped, F.col("unique_id"), read_instant(F.col("endTime")), F.col("value"))


def extract_single(df: DataFrame, unique_id: str | Column) -> DataFrame:
    """One dataset: the value is the first column that is not a time."""
    value = next(c for c in df.columns if c not in ("startTime", "endTime", "unique_id"))
    name = F.lit(unique_id) if isinstance(unique_id, str) else unique_id
    return _points(df, name, read_instant(F.col("endTime")), F.col(value))


def extract_pairs(payloads: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """``{"series": [[ms, value], ...]}`` chunks with ``chunk_ts``.

    A millisecond keeps its first value in chunk order, missing or not; missing ones go after
    that. Instants are epoch UTC. The first value is picked with map-side partial results.
    """
    rows = payloads.select(
        "unique_id", "chunk_ts", F.posexplode(F.from_json("payload", PAIRS)["series"]).alias("_at", "_p")
    ).select("unique_id", "chunk_ts", "_at", F.col("_p")[0].cast("long").alias("ms"), F.col("_p")[1].alias("value"))
    first = keep_one(rows, ["unique_id", "ms"], ["chunk_ts", "_at"], last=False)
    kept = _points(first, F.col("unique_id"), F.timestamp_millis("ms"), F.col("value")).filter(F.col("value").isNotNull())
    if start is not None:
        kept = kept.filter(F.col("ts") >= instant(start))
    if end is not None:
        kept = kept.filter(F.col("ts") <= instant(end))
    return kept


def extract_records(payloads: DataFrame) -> DataFrame:
    """Paged records of period and value; rows missing either are dropped. Pages are plain rows."""
    rows = payloads.select("unique_id", F.explode(F.from_json("payload", RECORDS)["response"]["data"]).alias("p"))
    kept = rows.filter(F.col("p.period").isNotNull() & F.col("p.value").isNotNull())
    return _points(kept, F.col("unique_id"), read_instant(F.col("p.period")), F.col("p.value"))


def extract_market_xml(payloads: DataFrame) -> DataFrame:
    """Time series / period / points; an instant is the period start plus index times step."""
    series = payloads.select("unique_id", F.explode(F.from_xml("payload", MARKET_XML)["TimeSeries"]).alias("s"))
    points = series.select(
        "unique_id", read_instant(F.col("s.Period.timeInterval.start")).alias("_start"),
        F.col("s.Period.resolution").alias("_resolution"), F.posexplode("s.Period.Point").alias("_i", "_p"),
    )
    step = F.lit(OTHER_STEP_S)
    for name, seconds in MARKET_STEPS.items():
        step = F.when(F.col("_resolution") == name, F.lit(seconds)).otherwise(step)
    return _points(points, F.col("unique_id"), shift(F.col("_start"), F.col("_i") * step), F.col("_p.quantity"))


def extract_garages(payloads: DataFrame, series_defs: DataFrame) -> DataFrame:
    """Free spaces per named garage and in total; counts that do not parse are left out.

    ``payloads`` has poll_ts and payload; ``series_defs`` maps garage (or "total") to unique_id.
    Local times become UTC; a time that does not parse falls back to the poll.
    """
    rows = payloads.select("poll_ts", F.explode(F.from_xml("payload", GARAGE_XML)["parkhaus"]).alias("g"))
    local = F.try_to_timestamp(F.trim("g.zeitstempel"), F.lit("dd.MM.yyyy HH:mm"))
    parsed = rows.select(
        "poll_ts", F.lower(F.trim("g.bezeichnung")).alias("garage"), F.trim("g.frei").try_cast("int").alias("free"),
        F.coalesce(local_to_utc(local, LOCAL_ZONE), F.col("poll_ts")).alias("ts"),
    ).filter(F.col("free").isNotNull())
    names = series_defs.select(F.lower("garage").alias("garage"), "unique_id")
    columns = ["garage", "ts", "free"]
    total = parsed.groupBy(F.col("poll_ts").alias("ts")).agg(F.sum("free").alias("free")).withColumn("garage", F.lit(TOTAL))
    each = parsed.filter(F.col("garage") != TOTAL).select(*columns)
    both = each.unionByName(total.select(*columns)).join(names, "garage")
    return _points(both, F.col("unique_id"), F.col("ts"), F.col("free"))


def extract_stations(payloads: DataFrame, series_defs: DataFrame) -> DataFrame:
    """Station lists to network totals per poll and metric; missing counts are 0.

    ``payloads`` has network, poll_ts and payload; ``series_defs`` has network, metric and unique_id.
    """
    rows = payloads.select("network", "poll_ts", F.explode(F.from_json("payload", STATIONS)).alias("s"))
    none = F.lit(0)
    ebikes = F.coalesce(F.nullif("s.extra.ebike", none), "s.extra.ebikes", none)
    totals = rows.groupBy("network", "poll_ts").agg(
        F.sum(F.coalesce("s.free_bikes", none)).cast("double").alias("free_bikes"),
        F.sum(F.coalesce("s.empty_slots", none)).cast("double").alias("empty_slots"),
        F.sum(ebikes).cast("double").alias("ebikes"),
        F.sum(F.coalesce("s.extra.normal_bikes", none)).cast("double").alias("normal_bikes"),
    )
    long = totals.unpivot(["network", "poll_ts"], list(METRICS), "metric", "_total")
    return _points(long.join(series_defs, ["network", "metric"]), F.col("unique_id"), F.col("poll_ts"), F.col("_total"))


def extract_live_prices(payloads: DataFrame, stations: DataFrame, series_defs: DataFrame) -> DataFrame:
    """Open stations' prices per city, and the mean over all configured open stations.

    ``payloads`` has poll_ts and payload; ``stations`` has station and city (NULL outside cities);
    ``series_defs`` has city (or "national"), fuel and unique_id.
    """
    rows = payloads.select(floor_to(F.col("poll_ts"), 600).alias("ts"), F.explode(F.from_json("payload", LIVE_PRICES)).alias("station", "p"))
    open_only = rows.filter(F.col("p.status") == "open").join(stations, "station")
    long = open_only.select("ts", "city", *[F.col(f"p.{f}").alias(f) for f in FUELS]).unpivot(["ts", "city"], list(FUELS), "fuel", "_price")
    good = long.filter((F.col("_price") > 0) & (F.col("_price") < MAX_PRICE)).withColumn("_price", F.round("_price", 4))
    national = good.groupBy("ts", "fuel").agg(F.round(F.avg("_price"), 4).alias("_price")).withColumn("city", F.lit(NATIONAL))
    columns = ["ts", "city", "fuel", "_price"]
    both = good.select(*columns).unionByName(national.select(*columns)).join(series_defs, ["city", "fuel"])
    return _points(both, F.col("unique_id"), F.col("ts"), F.col("_price"))


def price_events(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """Wide price rows (date, station_uuid, fuels) of configured stations as events; 0 means no price."""
    kept = rows.join(stations.select(F.col("station").alias("station_uuid")).distinct(), "station_uuid", "left_semi")
    long = kept.select(F.col("station_uuid").alias("station"), F.col("date").alias("ts"), *FUELS).unpivot(
        ["station", "ts"], list(FUELS), "fuel", "price"
    )
    return long.withColumn("price", F.when(F.col("price") > 0, F.col("price"))).filter(F.col("price").isNotNull())


def read_price_csv(spark, path: str | Sequence[str], stations: DataFrame) -> DataFrame:
    """Daily price files with a fixed schema; unreadable numbers become NULL."""
    schema = "date timestamp, station_uuid string, diesel double, e5 double, e10 double"
    reader = spark.read.option("header", True).option("enforceSchema", False).option("timestampFormat", PRICE_TIME)
    raw = reader.schema(schema).csv(path)
    return price_events(raw, stations)


def union_slices(slices: Sequence[DataFrame]) -> DataFrame:
    """Daily slices as one table; columns missing in a slice are NULL."""
    whole = slices[0]
    for part in slices[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def to_series(points: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with series ids, and the unique ids the catalogue does not know."""
    ids = catalogue.select("unique_id", "series_id")
    known = points.join(ids, "unique_id").select("series_id", "ts", "value")
    unknown = points.select("unique_id").distinct().join(ids, "unique_id", "left_anti")
    return known, unknown
