"""Versioned tables: merge, snapshots and point-in-time reads."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forescale.functions.times import instant, valid_at
from forescale.operators.forecasts import points_in_order, quantiles
from forescale.operators.ordered import keep_one
from forescale.session import small_table

POINT = ["series_id", "ts"]
SLICE_ROWS = 250_000  # versions of one series that one task joins with all that is asked of it


def merge_actions(
    history: DataFrame, batch: DataFrame, keys: Sequence[str], attributes: Sequence[str], as_of: datetime | str,
    order: Sequence[Column | str] = ("batch_seq",),
) -> DataFrame:
    """New state of a versioned table with an ``action`` per row: kept, closed or inserted.

    The batch keeps its last row per key. A current row whose attributes differ (NULLs equal)
    is closed and followed by a new version; an equal one stays; an unseen key opens a version.
    Only current rows meet the batch; closed ones pass through without a shuffle.
    """
    keys, attributes = list(keys), list(attributes)
    now = instant(as_of)
    latest = keep_one(batch.select(*keys, *attributes, *[o for o in order if isinstance(o, str)]), keys, order)
    new = latest.select(*keys, F.struct(*attributes).alias("_new"))
    current = history.filter("is_current")
    rest = [c for c in history.columns if c not in keys]
    old = current.select(*keys, F.struct(*rest).alias("_old"))
    joined = old.join(new, keys, "full_outer")
    differs = F.lit(False)
    for name in attributes:
        differs = differs | ~F.col("_old")[name].eqNullSafe(F.col("_new")[name])
    changed = F.col("_old").isNotNull() & F.col("_new").isNotNull() & differs
    types = {f.name: f.dataType.simpleString() for f in history.schema.fields}
    opened = {**{a: F.col("_new")[a] for a in attributes}, "valid_from": now, "valid_to": F.lit(None), "is_current": F.lit(True)}

    def version(values: dict[str, Column], action: str) -> Column:
        fields = [values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in rest]
        return F.struct(*fields, F.lit(action).alias("action"))

    kept = version({c: F.col("_old")[c] for c in rest}, "kept")
    closed = version({**{c: F.col("_old")[c] for c in rest}, "valid_to": now, "is_current": F.lit(False)}, "closed")
    inserted = version(opened, "inserted")
    rows = F.when(F.col("_old").isNull(), F.array(inserted)).when(changed, F.array(closed, inserted)).otherwise(F.array(kept))
    merged = joined.select(*keys, F.explode(rows).alias("_v")).select(*keys, "_v.*")
    past = history.filter(~F.col("is_current")).withColumn("action", F.lit("kept"))
    return merged.select(*history.columns, "action").unionByName(past)


def merge_points(history: DataFrame, batch: DataFrame, as_of: datetime | str) -> DataFrame:
    """Versioned points after a batch of (series_id, ts, value, quality_code, batch_seq)."""
    rows = batch.filter(F.col("ts").isNotNull()).withColumn("quality_code", F.coalesce("quality_code", F.lit(0)).cast("short"))
    return merge_actions(history, rows, POINT, ["value", "quality_code"], as_of)


def merge_counts(actions: DataFrame, batch: DataFrame, keys: Sequence[str] = tuple(POINT)) -> DataFrame:
    """Inserted, updated and unchanged counters.

    ``unchanged`` takes changed keys off twice, as they count as updated and as inserted;
    ``unchanged_exact`` takes them off once.
    """
    tally = actions.agg(
        F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "closed").alias("updated"),
        F.lit(0).cast("long").alias("n"),
    )
    none = F.lit(0).cast("long")
    size = batch.select(*keys).distinct().agg(none.alias("inserted"), none.alias("updated"), F.count(F.lit(1)).alias("n"))
    both = tally.unionByName(size).agg(*[F.sum(c).alias(c) for c in ("inserted", "updated", "n")])
    return both.select(
        "inserted", "updated", F.greatest(F.col("n") - F.col("inserted") - F.col("updated"), F.lit(0)).alias("unchanged"),
        (F.col("n") - F.col("inserted")).alias("unchanged_exact"),
    )


def assign(assignments: DataFrame, batch: DataFrame, as_of: datetime | str) -> DataFrame:
    """Series assignments of definitions: no-op when current with the same flag, else close and open."""
    rows = batch.withColumn("is_required", F.coalesce("is_required", F.lit(True)))
    order = [c for c in ("batch_seq",) if c in batch.columns]
    state = merge_actions(assignments, rows, ["definition_id", "series_id"], ["is_required"], as_of, order)
    return state.withColumn("is_excluded", F.coalesce("is_excluded", F.lit(False)))


def close_unlisted(assignments: DataFrame, listed: DataFrame, definitions: DataFrame, as_of: datetime | str) -> DataFrame:
    """Closes current assignments of the given definitions that are not listed; no list closes all."""
    keys = ["definition_id", "series_id"]
    marks = listed.select(*keys).distinct().withColumn("_listed", F.lit(True))
    managed = definitions.select("definition_id").distinct().withColumn("_managed", F.lit(True))
    drop = F.col("is_current") & F.col("_managed").isNotNull() & F.col("_listed").isNull()
    return (
        assignments.join(marks, keys, "left").join(managed, "definition_id", "left")
        .withColumn("valid_to", F.when(drop, instant(as_of)).otherwise(F.col("valid_to")))
        .withColumn("is_current", F.col("is_current") & ~drop)
        .select(*assignments.columns)
    )


def sync_assignments(assignments: DataFrame, listed: DataFrame, definitions: DataFrame, as_of: datetime | str) -> DataFrame:
    """Upserts the listed assignments and closes the others of the managed definitions."""
    state = assign(assignments, listed, as_of).select(*assignments.columns)
    return close_unlisted(state, listed, definitions, as_of)


def mark_excluded(assignments: DataFrame, pairs: DataFrame, excluded: bool = True) -> DataFrame:
    """Sets the flag on every version of the (definition, series) pairs."""
    keys = ["definition_id", "series_id"]
    hit = pairs.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return assignments.join(hit, keys, "left").withColumn(
        "is_excluded", F.when(F.col("_hit"), F.lit(excluded)).otherwise(F.col("is_excluded"))
    ).select(*assignments.columns)


def at_time(history: DataFrame, moment: datetime | str, series_id: int | None = None,
            start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Versions valid at an instant, optionally of one series and an inclusive time range."""
    kept = history.filter(valid_at(instant(moment), F.col("valid_from"), F.col("valid_to")))
    if series_id is not None:
        kept = kept.filter(F.col("series_id") == series_id)
    if start is not None:
        kept = kept.filter(F.col("ts") >= instant(start))
    if end is not None:
        kept = kept.filter(F.col("ts") <= instant(end))
    return kept


def register_at_time(history: DataFrame, name: str = "points_at_time") -> None:
    """SQL table function over the history: ``SELECT * FROM points_at_time(TIMESTAMP '...', 5)``."""
    spark = history.sparkSession
    view = f"{name}_history"
    history.createOrReplaceTempView(view)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(at_time TIMESTAMP, wanted INT DEFAULT NULL) "
        "RETURNS TABLE (series_id INT, ts TIMESTAMP, value DOUBLE, quality_code SMALLINT, valid_from TIMESTAMP, valid_to TIMESTAMP) "
        f"RETURN SELECT h.series_id, h.ts, h.value, h.quality_code, h.valid_from, h.valid_to FROM {view} h "
        "WHERE h.valid_from <= at_time AND (h.valid_to IS NULL OR at_time < h.valid_to) AND (wanted IS NULL OR h.series_id = wanted)"
    )


def current(history: DataFrame) -> DataFrame:
    return history.filter("is_current")


def value_history(history: DataFrame, keys: DataFrame) -> DataFrame:
    """Every version of the given (series, ts) keys, oldest first."""
    return history.join(keys.select(*POINT).distinct(), POINT, "left_semi").orderBy(*POINT, "valid_from")


def changes_summary(history: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Points, versions, changes and closed versions per series.

    Versions merge per (series, ts) first, so points are counted without a distinct set.
    """
    kept = history
    if start is not None:
        kept = kept.filter(F.col("ts") >= instant(start))
    if end is not None:
        kept = kept.filter(F.col("ts") <= instant(end))
    per_point = kept.groupBy(*POINT).agg(F.count(F.lit(1)).alias("_v"), F.count_if(~F.col("is_current")).alias("_c"))
    return per_point.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("total_datapoints"), F.sum("_v").alias("total_versions"),
        (F.sum("_v") - F.count(F.lit(1))).alias("total_changes"), F.sum("_c").alias("historical_versions"),
    )


def round_instants(rounds: DataFrame, scores: DataFrame, as_of: datetime | str) -> DataFrame:
    """Per round: creation time for the context, and the newest final calculation (else ``as_of``) for actuals."""
    done = scores.filter("final_evaluation").groupBy("round_id").agg(F.max("calculated_at").alias("_done"))
    return rounds.select(F.col("id").alias("round_id"), "created_at", "start_time", "end_time").join(done, "round_id", "left").withColumn(
        "eval_time", F.coalesce(F.col("_done"), instant(as_of))
    ).drop("_done")


def dyadic_cover(low: Column, high: Column, levels: int) -> Column:
    """Whole numbers from ``low`` up to before ``high`` as few blocks: (level, block) stands for 2^level numbers from block * 2^level."""
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    down = lambda k: F.floor(high / power(k)).cast("long")
    up = lambda k: F.ceil(low / power(k)).cast("long")
    odd = lambda n: n.bitwiseAND(F.lit(1).cast("long")) == 1
    block = lambda k, n: F.struct(k.alias("level"), n.alias("block"))

    def at(k: Column) -> Column:
        inside = up(k) < down(k)
        return F.array(F.when(inside & odd(up(k)), block(k, up(k))), F.when(inside & odd(down(k)), block(k, down(k) - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))


def slices(history: DataFrame, key: str, rows: int) -> DataFrame:
    """``key`` and ``_slices`` of those keys that hold more than ``rows`` rows: at most one key in so many rows, so a local table."""
    many = history.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > rows) & F.col(key).isNotNull()).collect()
    return small_table(history.sparkSession, [(r[0], -(-r["n"] // rows)) for r in many], f"{key} {history.schema[key].dataType.simpleString()}, _slices int")


def versions_at(history: DataFrame, wanted: DataFrame, moment: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows of ``wanted`` (series_id, an instant each, any more) with every version of their series that is valid at it.

    All that is asked of a series travels as one row, which the number of rounds bounds, and every version travels once.
    A series of more than ``slice_rows`` versions is cut into slices by their instants; what is asked of it goes to each.
    """
    hot = slices(history, "series_id", slice_rows)
    rest = [c for c in wanted.columns if c != "series_id"]
    asked = wanted.where(F.col(moment).isNotNull()).groupBy("series_id").agg(F.collect_list(F.struct(*rest)).alias("_asked"))
    some = F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)
    asked = asked.join(hot, "series_id", "left").select("series_id", "_asked", F.explode(some).alias("_slice"))
    version = [*POINT, "value", "quality_code", "valid_from", "valid_to"]
    slice_ = F.when(F.col("_slices").isNull(), F.lit(0)).otherwise(F.pmod(F.hash("ts", "valid_from"), F.col("_slices")))
    known = history.join(hot, "series_id", "left").select(*version, slice_.alias("_slice"))
    met = known.join(asked, ["series_id", "_slice"]).select(*version, F.explode("_asked").alias("_a"))
    met = met.where(valid_at(F.col("_a")[moment], F.col("valid_from"), F.col("valid_to")))
    return met.select("series_id", *[F.col("_a")[c].alias(c) for c in rest], *version[1:])


def round_context(instants: DataFrame, pseudo: DataFrame, history: DataFrame, since: datetime | str | None = None) -> DataFrame:
    """Everything known of a round's series at its creation, before its window.

    The result itself is rounds x history of their series, so pass the rounds that are wanted.
    ``since`` bounds the reach back.
    """
    wanted = pseudo.select("round_id", "series_id", "challenge_series_name").join(instants.select("round_id", "created_at", "start_time"), "round_id")
    known = history if since is None else history.filter(F.col("ts") >= instant(since))
    return versions_at(known, wanted, "created_at").where(F.col("ts") < F.col("start_time")).select(
        "round_id", "series_id", "challenge_series_name", "ts", "value"
    )


def round_actuals(instants: DataFrame, pseudo: DataFrame, history: DataFrame) -> DataFrame:
    """Values inside each round's window as known at its evaluation.

    Windows are unrolled to days, so a version meets only the rounds that cover its day.
    """
    day = F.explode(F.sequence(F.to_date("start_time"), F.to_date("end_time"))).alias("_day")
    spans = instants.filter(F.col("start_time") <= F.col("end_time")).select("round_id", "start_time", "end_time", "eval_time", day)
    wanted = pseudo.select("round_id", "series_id", "challenge_series_name").join(spans, "round_id")
    known = history.select(*POINT, "value", "valid_from", "valid_to", F.to_date("ts").alias("_day"))
    return (
        wanted.join(known, ["series_id", "_day"])
        .filter(F.col("ts").between(F.col("start_time"), F.col("end_time")) & valid_at(F.col("eval_time"), F.col("valid_from"), F.col("valid_to")))
        .select("round_id", "series_id", "challenge_series_name", "ts", "value")
    )


def round_forecasts(instants: DataFrame, pseudo: DataFrame, forecasts: DataFrame, models: DataFrame) -> DataFrame:
    names = pseudo.select("round_id", "series_id", "challenge_series_name")
    who = models.select(F.col("id").alias("model_id"), "readable_id")
    return (
        forecasts.join(instants.select("round_id"), "round_id", "left_semi")
        .join(names, ["round_id", "series_id"]).join(who, "model_id")
        .select("round_id", "series_id", "challenge_series_name", "readable_id", "ts", F.col("predicted_value").alias("value"), quantiles(forecasts))
    )


def nested_round(actuals: DataFrame, forecasts: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Per round and series: context and actuals in time order and a map from model to its points (one horizon each).

    Context is gathered by day first, so no task sorts the points of a whole history.
    """
    points = F.array_sort(F.collect_list(F.struct("ts", "value")))
    keys = ["round_id", "series_id", "challenge_series_name"]
    per_model = forecasts.groupBy(*keys, "readable_id").agg(points_in_order("value", "value").alias("_p"))
    by_model = per_model.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("readable_id", "_p"))).alias("forecasts"))
    nested = actuals.groupBy(*keys).agg(points.alias("actuals")).join(by_model, keys, "full_outer")
    if context is None:
        return nested
    days = context.groupBy(*keys, F.to_date("ts").alias("day")).agg(points.alias("points"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("day", "points"))), lambda d: d["points"]))
    return nested.join(days.groupBy(*keys).agg(whole.alias("context")), keys, "full_outer")
