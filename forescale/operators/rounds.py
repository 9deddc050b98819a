"""Rounds: creation, status, choice of series, frozen context and listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forescale.functions.durations import resolution_of, resolution_seconds
from forescale.functions.text import order_key, pseudonym, round_name
from forescale.functions.times import instant, shift
from forescale.operators.rollup import context_stats

DEFAULT_REGISTRATION_S = 3600
FILTER_LISTS = ("domains", "subdomains", "categories", "subcategories")
SAMPLE_SLICES = 64


def status_of(as_of: Column) -> Column:
    """Status from the clock alone; both ends of registration count, NULL bounds give undefined."""
    return (
        F.when((as_of >= F.col("registration_start")) & (as_of <= F.col("registration_end")), F.lit("registration"))
        .when((as_of > F.col("registration_end")) & (as_of <= F.col("end_time")), F.lit("active"))
        .when(as_of > F.col("end_time"), F.lit("completed"))
        .otherwise(F.lit("undefined"))
    )


def round_status(rounds: DataFrame, definitions: DataFrame, as_of: datetime | str) -> DataFrame:
    """Rounds with definition fields, computed status, and status with cancellation first."""
    dims = definitions.select(
        F.col("id").alias("definition_id"), F.col("schedule_id").alias("definition_schedule_id"),
        F.col("name").alias("definition_name"), *[F.col(c).alias(f"definition_{c}") for c in FILTER_LISTS],
    )
    joined = rounds.join(dims, "definition_id", "left").withColumn("computed_status", status_of(instant(as_of)))
    cancelled = F.coalesce(F.col("is_cancelled"), F.lit(False))
    return joined.withColumn("status", F.when(cancelled, F.lit("cancelled")).otherwise(F.col("computed_status")))


def create_rounds(definitions: DataFrame, starts: DataFrame) -> DataFrame:
    """One round per definition and registration start; ``starts`` has definition_id, id, registration_start."""
    reg_end = shift(F.col("registration_start"), F.coalesce(F.col("registration_s"), F.lit(DEFAULT_REGISTRATION_S)))
    dims = definitions.select(
        F.col("id").alias("definition_id"), F.col("name").alias("_name"),
        "context_length", "horizon_s", "frequency_s", "registration_s",
    )
    return (
        starts.join(dims, "definition_id")
        .withColumn("registration_end", reg_end)
        .withColumn("start_time", F.col("registration_end"))
        .withColumn("end_time", shift(F.col("start_time"), F.col("horizon_s")))
        .select(
            "id", "definition_id", round_name(F.col("_name"), F.col("registration_start")).alias("name"),
            "context_length", "horizon_s", "frequency_s", "registration_start", "registration_end",
            "start_time", "end_time", F.lit(False).alias("is_cancelled"),
            F.col("registration_start").alias("created_at"),
        )
    )


def eligible_series(definitions: DataFrame, availability: DataFrame, only_recent: bool = True) -> DataFrame:
    """(definition_id, series_id) pairs that pass each definition's lists and frequency.

    An empty list or one with "mixed" lets everything through. Both sides are turned into
    tokens ("*" for no filter), which makes the match one equi join instead of a comparison
    of every definition with every series.
    """
    singular = {"domains": "domain", "subdomains": "subdomain", "categories": "category", "subcategories": "subcategory"}
    left = definitions.select(F.col("id").alias("definition_id"), F.col("frequency_s").alias("_target"), *FILTER_LISTS)
    right = availability
    if only_recent:
        right = right.filter("has_recent_data")
    kinds = right.select(*singular.values()).distinct()
    for plural, name in singular.items():
        values = F.coalesce(F.col(plural), F.array().cast("array<string>"))
        open_list = (F.size(values) == 0) | F.array_contains(values, "mixed")
        tokens = F.when(open_list, F.array(F.lit("*"))).otherwise(F.transform(F.array_distinct(values), lambda v: F.concat(F.lit("="), v)))
        left = left.withColumn(f"_t_{name}", F.explode(tokens)).drop(plural)
        own = F.array_compact(F.array(F.lit("*"), F.concat(F.lit("="), F.col(name))))
        kinds = kinds.withColumn(f"_t_{name}", F.explode(own))
    keys = [f"_t_{name}" for name in singular.values()]
    pairs = left.join(kinds, keys).drop(*keys).alias("p")
    match = F.lit(True)
    for name in singular.values():
        match = match & F.col(f"p.{name}").eqNullSafe(F.col(f"s.{name}"))
    found = pairs.join(right.alias("s"), match)
    return found.filter(F.col("s.frequency_s") <= F.col("p._target")).select("definition_id", "s.series_id")


def current_series(assignments: DataFrame) -> DataFrame:
    return assignments.filter("is_current").select("definition_id", "series_id").distinct()


def choose_series(
    rounds: DataFrame, definitions: DataFrame, assignments: DataFrame, eligible: DataFrame, seed: int
) -> DataFrame:
    """(round_id, series_id, is_sampled): the definition's current series, else a seeded sample.

    The sample ranks by a hash of seed, round and series and keeps ``n_time_series``. Ranks are
    taken within slices of a round's candidates first, so a round that may draw from millions of
    series sends only the best of each slice to its final ranking; the result is the same.
    """
    keys = rounds.select(F.col("id").alias("round_id"), "definition_id")
    required = current_series(assignments)
    fixed = keys.join(required, "definition_id").select("round_id", "series_id", F.lit(False).alias("is_sampled"))
    open_rounds = keys.join(required.select("definition_id").distinct(), "definition_id", "left_anti")
    limits = definitions.select(F.col("id").alias("definition_id"), "n_time_series")
    drawn = (
        open_rounds.join(limits, "definition_id")
        .join(eligible, "definition_id")
        .withColumn("_key", order_key(seed, F.col("round_id"), F.col("series_id")))
        .withColumn("_slice", F.pmod(F.hash("series_id"), F.lit(SAMPLE_SLICES)))
    )
    ranked = drawn
    for group in (["round_id", "_slice"], ["round_id"]):
        best = W.partitionBy(*group).orderBy("_key", "series_id")
        ranked = ranked.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= F.col("n_time_series"))
    return fixed.unionByName(ranked.select("round_id", "series_id", F.lit(True).alias("is_sampled")))


def asked_levels(rounds: DataFrame, chosen: DataFrame) -> DataFrame:
    """The series that rounds chose, each once per resolution that a round of it has."""
    levels = rounds.select(F.col("id").alias("round_id"), resolution_of(F.col("frequency_s")).alias("resolution"))
    return chosen.join(levels, "round_id").select("resolution", "series_id").distinct()


def context_snapshot(rounds: DataFrame, chosen: DataFrame, rollups: DataFrame) -> DataFrame:
    """Last ``context_length`` buckets per round and series, closed by the round's registration start.

    Only series that a round chose are numbered, up to the last start that needs them. Positions within a series (rollup rows are bounded by the calendar) turn "last n before t"
    into a position range. Ranges are joined through blocks of positions, so a row meets only
    the rounds whose window covers its block, never all rounds of its series. Keys begin with the
    series: sorts compare the first key quickly, and resolutions are few.
    """
    key = ["series_id", "resolution"]
    width = resolution_seconds(F.col("resolution"))
    closed = shift(F.col("ts"), width)
    by_time = W.partitionBy(*key).orderBy("ts")
    wanted = chosen.join(
        rounds.select(
            F.col("id").alias("round_id"), resolution_of(F.col("frequency_s")).alias("resolution"),
            F.col("registration_start").alias("_cut"), F.col("context_length").cast("long").alias("_n"),
        ),
        "round_id",
    ).select("round_id", "_cut", "_n", *key)
    reach = wanted.groupBy(*key).agg(F.max("_cut").alias("_last"))
    seen = rollups.select(*key, "ts", "value").join(reach, key).filter(F.col("ts") < F.col("_last")).drop("_last")
    placed = seen.withColumn("_pos", F.row_number().over(by_time).cast("long"))
    nothing = F.lit(None)
    marks = placed.select(*key, closed.alias("_t"), F.lit(0).alias("_kind"), "_pos",
                          nothing.cast("int").alias("round_id"), nothing.cast("long").alias("_n"))
    asks = wanted.select(*key, F.col("_cut").alias("_t"), F.lit(1).alias("_kind"), nothing.cast("long").alias("_pos"),
                         F.col("round_id").cast("int").alias("round_id"), "_n")
    sofar = W.partitionBy(*key).orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0)
    ends = (
        marks.unionByName(asks)
        .withColumn("_end", F.last("_pos", ignorenulls=True).over(sofar))
        .filter((F.col("_kind") == 1) & F.col("_end").isNotNull())
        .select(*key, "round_id", "_end", F.greatest(F.col("_end") - F.col("_n") + 1, F.lit(1)).alias("_first"))
    )

    def block(position: Column) -> Column:
        return F.shiftright(position, 8)

    spans = ends.withColumn("_block", F.explode(F.sequence(block(F.col("_first")), block(F.col("_end")))))
    return (
        placed.withColumn("_block", block(F.col("_pos")))
        .join(spans, [*key, "_block"])
        .filter(F.col("_pos").between(F.col("_first"), F.col("_end")))
        .select("round_id", "series_id", "ts", "value")
    )


def series_pseudonyms(chosen: DataFrame, series: DataFrame, context: DataFrame) -> DataFrame:
    """Round series with their public name and context statistics; only sampled series are hidden."""
    names = series.select("series_id", F.coalesce("unique_id", "name").alias("_own"))
    shown = F.when(F.col("is_sampled"), pseudonym(F.col("round_id"), F.col("series_id"))).otherwise(
        F.coalesce(F.col("_own"), F.concat(F.lit("series_"), F.col("series_id").cast("string")))
    )
    return (
        chosen.join(names, "series_id")
        .join(context_stats(context), ["series_id", "round_id"], "left")
        .select("round_id", "series_id", shown.alias("challenge_series_name"), "min_ts", "max_ts", "value_avg", "value_std")
    )


def retime_rounds(rounds: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Forecast window starts one step after the newest context instant; rounds without any are cancelled."""
    newest = pseudo.groupBy(F.col("round_id").alias("id")).agg(F.max("max_ts").alias("_max"))
    start = shift(F.col("_max"), F.col("frequency_s"))
    return (
        rounds.join(newest, "id", "left")
        .withColumn("start_time", F.coalesce(start, F.col("start_time")))
        .withColumn("end_time", F.when(F.col("_max").isNotNull(), shift(F.col("start_time"), F.col("horizon_s"))).otherwise(F.col("end_time")))
        .withColumn("is_cancelled", F.col("is_cancelled") | F.col("_max").isNull())
        .select(*rounds.columns)
    )


def rounds_with_metadata(
    rounds: DataFrame, definitions: DataFrame, pseudo: DataFrame, series: DataFrame, category: DataFrame,
    forecasts: DataFrame, as_of: datetime | str,
) -> DataFrame:
    """Rounds with series count, category lists, model count and forecast count.

    Forecasts shrink to one row per (round, model) before models are counted, so no distinct
    set is built and the counts come out of one pass.
    """
    kinds = series.select("series_id", "category_id").join(
        category.select(F.col("id").alias("category_id"), "category", "subcategory"), "category_id", "left"
    )
    per_round = (
        pseudo.select("round_id", "series_id").distinct().join(kinds, "series_id", "left")
        .groupBy("round_id")
        .agg(
            F.count("series_id").alias("n_time_series"),
            F.array_sort(F.collect_set("category")).alias("categories"),
            F.array_sort(F.collect_set("subcategory")).alias("subcategories"),
        )
    )
    per_model = forecasts.groupBy("round_id", "model_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = per_model.groupBy("round_id").agg(
        F.count(F.lit(1)).alias("model_count"), F.sum("_n").alias("forecast_count")
    )
    none = F.array().cast("array<string>")
    base = round_status(rounds, definitions, as_of).withColumnRenamed("id", "round_id")
    return (
        base.join(per_round, "round_id", "left")
        .join(counts, "round_id", "left")
        .withColumns({
            "domains": F.col("definition_domains"),
            "subdomains": F.col("definition_subdomains"),
            "categories": F.coalesce("categories", none),
            "subcategories": F.coalesce("subcategories", none),
            **{c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_time_series", "model_count", "forecast_count")},
        })
        .drop("definition_domains", "definition_subdomains")
    )


def filter_rounds(
    metadata: DataFrame, status: Sequence[str] = (), from_ts: datetime | str | None = None,
    to_ts: datetime | str | None = None, domains: Sequence[str] = (), categories: Sequence[str] = (),
    subcategories: Sequence[str] = (), frequencies_s: Sequence[int] = (), horizons_s: Sequence[int] = (),
    definition_id: int | None = None,
) -> DataFrame:
    """Rounds that match every given filter; arrays match on overlap."""
    kept = metadata
    if definition_id is not None:
        kept = kept.filter(F.col("definition_id") == definition_id)
    if from_ts is not None:
        kept = kept.filter(F.col("end_time") >= instant(from_ts))
    if to_ts is not None:
        kept = kept.filter(F.col("end_time") <= instant(to_ts))
    for column, values in (("status", status), ("frequency_s", frequencies_s), ("horizon_s", horizons_s)):
        if values:
            kept = kept.filter(F.col(column).isin(list(values)))
    for column, values in (("domains", domains), ("categories", categories), ("subcategories", subcategories)):
        if values:
            wanted = F.array(*[F.lit(v) for v in values])
            kept = kept.filter(F.coalesce(F.arrays_overlap(F.col(column), wanted), F.lit(False)))
    return kept


def status_order() -> list[Column]:
    """Active, registration, completed, the rest; newest first; id breaks ties."""
    rank = (
        F.when(F.col("status") == "active", 0).when(F.col("status") == "registration", 1)
        .when(F.col("status") == "completed", 2).otherwise(4)
    )
    return [rank.asc(), F.desc("created_at"), F.asc("round_id")]


def open_rounds(rounds: DataFrame, statuses: Sequence[str] = ("registration",), definition_id: int | None = None) -> DataFrame:
    """Rounds by status, earliest registration first and missing ones last."""
    kept = rounds.filter(F.col("status").isin(list(statuses)))
    if definition_id is not None:
        kept = kept.filter(F.col("definition_id") == definition_id)
    return kept.orderBy(F.asc_nulls_last("registration_start"), "id")


def page(rows: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """One page of a totally ordered listing."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def store_listing(rows: DataFrame, order: Sequence[Column | str], folder: str, parts: int | None = None) -> None:
    """A totally ordered listing as ranges, each in a folder of its own and sorted, to be paged by ``seek_page``.

    Without ``parts`` there are as many ranges as shuffle partitions.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows")
    stored = rows.sparkSession.read.schema("part int").parquet(f"{folder}/rows")
    stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/counts")


def seek_page(spark: SparkSession, folder: str, schema: T.StructType, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """One page of a stored listing (the last one for a ``number`` of 0): reads the ranges that hold it, whatever its number.

    The counts, one row a range, tell which those are.
    """
    counts = sorted(tuple(r) for r in spark.read.schema("part int, n long").parquet(f"{folder}/counts").collect())
    if not number:
        number = max(1, -(-sum(n for _, n in counts) // size))
    skip, held, before = (number - 1) * size, [], 0
    for part, n in counts:
        if before < skip + size and before + n > skip:
            held.append((part, before))
        before += n
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])).parquet(f"{folder}/rows")
    rows = rows.where(F.col("part").isin([part for part, _ in held])).drop("part")
    return rows.orderBy(*order).offset(skip - held[0][1] if held else 0).limit(size)


def page_info(rows: DataFrame, number: int, size: int, pages_when_empty: int = 1) -> DataFrame:
    """Total count and page flags of the same listing."""
    total = F.col("total_count")
    pages = F.when(total == 0, F.lit(pages_when_empty)).otherwise(F.ceil(total / size)).cast("long")
    return (
        rows.agg(F.count(F.lit(1)).alias("total_count"))
        .withColumn("total_pages", pages)
        .withColumn("has_next", F.lit(number) < F.col("total_pages"))
        .withColumn("has_previous", F.lit(number > 1))
    )


def filter_options(metadata: DataFrame) -> DataFrame:
    """(dimension, option) rows: every distinct domain, category, subcategory, frequency, horizon and status.

    Rows shrink to distinct combinations of the filter columns before the lists are unrolled.
    """
    def entries(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("dimension"), v.cast("string").alias("option")))

    none = F.array().cast("array<string>")
    lists = ["domains", "categories", "subcategories"]
    scalars = ["frequency_s", "horizon_s", "status"]
    small = metadata.select(*lists, *scalars).distinct()
    every = F.concat(
        *[entries(c, F.coalesce(F.col(c), none)) for c in lists],
        *[entries(c, F.array(F.col(c).cast("string"))) for c in scalars],
    )
    return small.select(F.explode(every).alias("e")).select("e.*").filter(F.col("option").isNotNull()).distinct()


def round_series(rounds: DataFrame, pseudo: DataFrame, series: DataFrame, category: DataFrame) -> DataFrame:
    """Series of every round with their catalogue and category fields."""
    dims = category.select(F.col("id").alias("category_id"), "domain", "category", "subcategory")
    windows = rounds.select(
        F.col("id").alias("round_id"), "definition_id", "horizon_s", "start_time", "end_time",
        "registration_start", "registration_end",
    )
    return (
        pseudo.select("round_id", "series_id", F.col("min_ts").alias("context_start_time"), F.col("max_ts").alias("context_end_time"))
        .join(windows, "round_id")
        .join(series.select("series_id", "name", "description", "frequency_s", "unique_id", "unit", "category_id"), "series_id")
        .join(dims, "category_id", "left")
        .drop("category_id")
    )


def definition_series(listing: DataFrame) -> DataFrame:
    """Distinct series that appeared in any round of a definition, from :func:`round_series`."""
    return listing.select(
        "definition_id", "series_id", "name", "description", "frequency_s", "unique_id", "domain", "category", "subcategory"
    ).distinct()


def active_definitions(definitions: DataFrame) -> DataFrame:
    return definitions.filter("is_active")


def visible(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """Rows of rounds that are not in registration any more; ``statuses`` has id and status."""
    shown = statuses.filter(F.col("status") != "registration").select(F.col("id").alias("round_id"))
    return rows.join(shown, "round_id", "left_semi")


def owned(rows: DataFrame, models: DataFrame, user_id: int, is_internal: bool) -> DataFrame:
    """Internal callers see everything, others only rows of their own models."""
    if is_internal:
        return rows
    mine = models.filter(F.col("user_id") == user_id).select(F.col("id").alias("model_id"))
    return rows.join(mine, "model_id", "left_semi")


def filter_series(series: DataFrame, category: DataFrame, domains: Sequence[str] = (), categories: Sequence[str] = (),
                  subcategories: Sequence[str] = (), frequency_s: int | None = None, unit: str | None = None) -> DataFrame:
    """Catalogue rows by category lists, frequency and unit; categories are joined only when asked for."""
    kept = series
    if frequency_s is not None:
        kept = kept.filter(F.col("frequency_s") == frequency_s)
    if unit is not None:
        kept = kept.filter(F.col("unit") == unit)
    wanted = category
    for column, values in (("domain", domains), ("category", categories), ("subcategory", subcategories)):
        if values:
            wanted = wanted.filter(F.col(column).isin(list(values)))
    if wanted is category:
        return kept
    return kept.join(wanted.select(F.col("id").alias("category_id")), "category_id", "left_semi").select(*series.columns)


def ending_in(rounds: DataFrame, year: int, month: int) -> DataFrame:
    return rounds.filter((F.year("end_time") == year) & (F.month("end_time") == month))
