"""Payloads as sources would land them, made from the given tables.

A payload holds at most ``PAGE`` consecutive events, so payloads grow in number, not in size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forescale.functions.times import shift
from forescale.plans.world import World

PAGE = 64


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def unit_id() -> Column:
    return F.concat(F.lit("ev-"), F.col("event_type")).alias("unique_id")


def _pages(events: DataFrame, keys: list, *fields: Column) -> DataFrame:
    """Events of a page in time order as an array ``rows``."""
    page = F.floor(F.col("event_id") / PAGE).alias("page")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("ts").alias("_ts"), F.col("event_id").alias("_id"), *fields)))
    return events.groupBy(*keys, page).agg(ordered.alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _json(field: str, rows: Column) -> Column:
    return F.to_json(F.struct(rows.alias(field)), {"ignoreNullFields": "false"})


def point_lists(w: World) -> DataFrame:
    pages = _pages(w.events, [unit_id()], F.col("value"))
    data = F.transform("rows", lambda r: F.struct(iso(r["_ts"]).alias("ts"), r["value"].alias("value")))
    return pages.select("unique_id", _json("data", data).alias("payload"))


def datasets(w: World) -> DataFrame:
    value = F.when(F.col("value") >= 5, F.col("value")).alias("value")
    pages = _pages(w.events, [], w.type_series().alias("kind"), value)
    data = F.transform("rows", lambda r: F.struct(r["kind"].alias("datasetId"), iso(r["_ts"]).alias("endTime"), r["value"].alias("value")))
    return pages.select(_json("data", data).alias("payload"))


def pairs(w: World) -> DataFrame:
    """Every page carries its events again after the next page's start, 1 higher."""
    value = F.when(F.col("value") >= 5, F.col("value")).alias("value")
    twice = w.events.withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1))))
    page = (F.floor(F.col("event_id") / PAGE) + F.col("_again")).alias("page")
    entry = F.struct(F.col("ts"), F.array(F.unix_millis("ts").cast("double"), F.when(F.col("value") >= 5, F.col("value") + F.col("_again"))).alias("p"))
    chunks = twice.groupBy(unit_id(), page).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    data = F.transform("rows", lambda r: r["p"])
    return chunks.select("unique_id", F.col("page").alias("chunk_ts"), _json("series", data).alias("payload"))


def records(w: World) -> DataFrame:
    text = F.when(F.col("value") >= 5, F.col("value").cast("string")).alias("value")
    pages = _pages(w.events, [unit_id()], text)
    data = F.transform("rows", lambda r: F.struct(iso(r["_ts"]).alias("period"), r["value"].alias("value")))
    inner = F.struct(F.size("rows").cast("string").alias("total"), data.alias("data"))
    return pages.select("unique_id", F.to_json(F.struct(inner.alias("response")), {"ignoreNullFields": "false"}).alias("payload"))


def _xml(items: Column) -> Column:
    return F.array_join(items, "")


def market_documents(w: World) -> DataFrame:
    pages = _pages(w.events, ["event_type"], F.col("value"))
    step = F.when(F.col("event_type") == "click", "PT60M").when(F.col("event_type") == "view", "PT15M").otherwise("PT5M")
    points = F.transform("rows", lambda r, i: F.concat(
        F.lit("<Point><position>"), (i + 1).cast("string"), F.lit("</position><quantity>"), r["value"].cast("string"), F.lit("</quantity></Point>")
    ))
    document = F.concat(
        F.lit("<Publication_MarketDocument><TimeSeries><Period><timeInterval><start>"), F.date_format(F.date_trunc("hour", "first_ts"), "yyyy-MM-dd'T'HH:mm'Z'"),
        F.lit("</start></timeInterval><resolution>"), step, F.lit("</resolution>"), _xml(points), F.lit("</Period></TimeSeries></Publication_MarketDocument>"),
    )
    return pages.select(F.concat(F.lit("ev-"), "event_type").alias("unique_id"), document.alias("payload"))


def garage_polls(w: World) -> DataFrame:
    free = F.when(F.col("event_type") == "error", "n/a").otherwise(F.floor("value").cast("string")).alias("free")
    stamp = F.when(F.col("event_type") == "signup", "soon").otherwise(F.date_format(shift(F.col("ts"), 3600), "dd.MM.yyyy HH:mm")).alias("stamp")
    pages = _pages(w.events, [], F.col("user_id"), free, stamp)
    garages = F.transform("rows", lambda r: F.concat(
        F.lit("<parkhaus><bezeichnung> Garage "), r["user_id"].cast("string"), F.lit(" </bezeichnung><frei> "), r["free"],
        F.lit(" </frei><status>frei</status><zeitstempel>"), r["stamp"], F.lit("</zeitstempel></parkhaus>"),
    ))
    return pages.select(F.col("last_ts").alias("poll_ts"), F.concat(F.lit("<parkhaeuser>"), _xml(garages), F.lit("</parkhaeuser>")).alias("payload"))


def garage_defs(w: World) -> DataFrame:
    each = w.events.select("user_id").distinct().select(
        F.concat(F.lit("GARAGE "), F.col("user_id").cast("string")).alias("garage"), F.concat(F.lit("g-"), F.col("user_id").cast("string")).alias("unique_id")
    )
    return each.unionByName(w.spark.range(1).select(F.lit("total").alias("garage"), F.lit("g-total").alias("unique_id")))


def station_polls(w: World) -> DataFrame:
    u = F.col("user_id").cast("int")
    extra = F.when(u % 4 != 0, F.struct(
        F.when(u % 3 != 0, u % 5).otherwise(0).alias("ebike"), (u % 7).alias("ebikes"),
        F.when(F.col("value") > 10, u % 11).alias("normal_bikes"),
    )).alias("extra")
    free = F.when(F.col("value") >= 5, F.floor("value").cast("int")).alias("free_bikes")
    pages = _pages(w.events, ["event_type"], free, (u % 20).alias("empty_slots"), extra)
    stations = F.transform("rows", lambda r: F.struct(r["free_bikes"].alias("free_bikes"), r["empty_slots"].alias("empty_slots"), r["extra"].alias("extra")))
    return pages.select(F.col("event_type").alias("network"), F.col("last_ts").alias("poll_ts"), F.to_json(stations, {"ignoreNullFields": "false"}).alias("payload"))


def station_defs(w: World) -> DataFrame:
    metrics = F.array(*[F.lit(m) for m in ("free_bikes", "empty_slots", "ebikes", "normal_bikes")])
    return w.events.select(F.col("event_type").alias("network")).distinct().select("network", F.explode(metrics).alias("metric")).withColumn(
        "unique_id", F.concat_ws("-", "network", "metric")
    )


def live_polls(w: World) -> DataFrame:
    page = F.floor(F.col("event_id") / PAGE).alias("page")
    one = w.events.groupBy(page, "user_id").agg(
        F.max("value").alias("value"), F.bool_or(F.col("event_type") == "error").alias("shut"), F.min("ts").alias("ts")
    )
    e5 = 1 + F.floor(F.col("value") / 10) / 8
    station = F.struct(
        F.concat(F.lit("st-"), F.col("user_id").cast("string")).alias("key"),
        F.struct(F.when(F.col("shut"), "closed").otherwise("open").alias("status"), e5.alias("e5"),
                 F.when(F.col("user_id") % 2 == 1, e5 - 0.5).alias("e10"), (e5 - 1).alias("diesel")).alias("value"),
    )
    polls = one.groupBy("page").agg(F.min("ts").alias("poll_ts"), F.map_from_entries(F.collect_list(station)).alias("prices"))
    return polls.select("poll_ts", F.to_json("prices", {"ignoreNullFields": "false"}).alias("payload"))


def live_stations(w: World) -> DataFrame:
    u = F.col("user_id")
    return w.events.select("user_id").distinct().filter(u % 10 != 9).select(
        F.concat(F.lit("st-"), u.cast("string")).alias("station"), F.when(u % 3 == 0, F.concat(F.lit("c-"), (u % 5).cast("string"))).alias("city")
    )


def live_defs(w: World) -> DataFrame:
    cities = F.array(*[F.lit(c) for c in ("c-0", "c-1", "c-2", "c-3", "national")])
    fuels = F.array(*[F.lit(f) for f in ("e5", "e10", "diesel")])
    return w.spark.range(1).select(F.explode(cities).alias("city")).select("city", F.explode(fuels).alias("fuel")).withColumn(
        "unique_id", F.concat_ws("-", "city", "fuel")
    )


def price_rows(w: World) -> DataFrame:
    """Wide price rows with a local time stamp and 0 for fuels without a price."""
    price = F.round(1 + F.floor(F.col("value") / 50) / 10, 2)
    local = F.concat(F.date_format(shift(F.col("ts"), 3600), "yyyy-MM-dd HH:mm:ss"), F.lit("+01"))
    e5 = F.col("event_type").isin("click", "signup")
    e10 = F.col("event_type") == "view"
    return w.events.select(
        local.alias("date"), F.concat(F.lit("st-"), F.col("user_id").cast("string")).alias("station_uuid"),
        F.when(~e5 & ~e10, price).otherwise(0.0).alias("diesel"), F.when(e5, price).otherwise(0.0).alias("e5"), F.when(e10, price).otherwise(0.0).alias("e10"),
    )


def catalogue_configs(w: World) -> DataFrame:
    """One source per part; attributes are missing here and there."""
    size = F.col("p_size")
    metadata = F.struct(
        F.when(size % 3 != 0, F.col("p_name")).alias("name"), F.lit(None).cast("string").alias("description"),
        F.when(size % 4 == 0, "15 minutes").when(size % 4 == 1, "PT1H").when(size % 4 == 2, "1 day").alias("frequency"),
        F.lit("EUR").alias("unit"), F.col("p_type").alias("domain"), F.when(size % 5 == 0, F.lit("metal")).alias("subdomain"),
        F.when(size % 2 == 0, F.col("p_brand")).alias("category"), F.when(size > 25, F.lit("large")).alias("subcategory"),
        F.when(size % 7 == 0, F.lit("linear")).alias("imputation_policy"), F.lit(None).cast("string").alias("update_frequency"),
        F.when(size % 6 == 0, F.lit("30 minutes")).alias("schedule"),
    )
    entry = F.struct(
        F.when(size != 13, F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))).alias("unique_id"),
        F.when(size % 9 == 0, F.lit("5 minutes")).alias("schedule"), metadata.alias("metadata"),
    )
    config = F.struct(
        F.when(size % 8 == 0, "plugins.SmardSource").otherwise("plugins.other").alias("module"),
        F.when(size % 2 == 1, F.concat(F.lit("group-"), F.col("p_brand"))).alias("group_id"), F.array(entry).alias("timeseries"),
    )
    return w.table("part").select(F.to_json(config).alias("payload"))
