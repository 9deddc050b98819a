"""Keyed, repeatable writes. Each operator returns the new state of the target table.

Plain Parquet has no row-level merge, so a caller writes the table anew, or logs what changed
(``streaming.log``); a table format with merge can take the same frames.
A key that a batch holds twice counts once: the row that sorts last by its other columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forescale.functions.times import instant
from forescale.operators.ordered import keep_one


def prefer_new(
    target: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str], nullable: Sequence[str] = ()
) -> DataFrame:
    """Full outer join on the keys; ``columns`` come from the new row where there is one.

    Plain equality keeps the partitioning of rows that were just grouped by the same keys, so
    they are not shuffled again. Keys in ``nullable`` match NULL with NULL.
    """
    keys = list(keys)
    old = target.select(F.struct(*target.columns).alias("o"), *[F.col(k).alias(f"_ok_{k}") for k in keys])
    new = rows.select(F.struct(*rows.columns).alias("n"), *[F.col(k).alias(f"_nk_{k}") for k in keys])
    match = F.lit(True)
    for key in keys:
        left, right = F.col(f"_ok_{key}"), F.col(f"_nk_{key}")
        match = match & (left.eqNullSafe(right) if key in nullable else left == right)
    joined = old.join(new, match, "full_outer")
    is_new = F.col("n").isNotNull()
    out = []
    for column in target.columns:
        if column in keys:
            out.append(F.when(is_new, F.col(f"_nk_{column}")).otherwise(F.col(f"_ok_{column}")).alias(column))
        elif column in columns:
            out.append(F.when(is_new, F.col("n")[column]).otherwise(F.col("o")[column]).alias(column))
        elif column in rows.columns:
            out.append(F.when(F.col("o").isNull(), F.col("n")[column]).otherwise(F.col("o")[column]).alias(column))
        else:
            out.append(F.col("o")[column].alias(column))
    return joined.select(*out)


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    as_of: datetime | str | None = None,
    order: Sequence[Column | str] = ("batch_seq",),
    stamp: str = "updated_at",
) -> DataFrame:
    """Last row per key of the batch replaces the target's attributes; stamp set on change."""
    drop = [o for o in order if isinstance(o, str) and o not in target.columns]
    latest = keep_one(batch, keys, order).drop(*drop)
    if as_of is not None and stamp in target.columns:
        latest = latest.withColumn(stamp, instant(as_of))
    return prefer_new(target, latest, keys, [c for c in latest.columns if c not in keys])


def upsert_points(current: DataFrame, batch: DataFrame, as_of: datetime | str) -> DataFrame:
    """Current values of (series_id, ts, value, updated_at) after a batch with ``batch_seq``."""
    clean = batch.filter(F.col("ts").isNotNull() & F.col("value").isNotNull())
    return upsert(current, clean.select("series_id", "ts", "value", "batch_seq"), ["series_id", "ts"], as_of)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """Rows to append: first per key by ``order``, without keys that the target has."""
    keys = list(keys)
    first = keep_one(rows, keys, order, last=False)
    return first.join(target.select(*keys), keys, "left_anti")


def upsert_scores(scores: DataFrame, rows: DataFrame, as_of: datetime | str) -> DataFrame:
    stamped = rows.withColumn("calculated_at", instant(as_of))
    keys = ["round_id", "model_id", "series_id"]
    return prefer_new(scores, keep_one(stamped, keys, []), keys, [c for c in stamped.columns if c not in keys])


def upsert_rankings(rankings: DataFrame, rows: DataFrame) -> DataFrame:
    """Snapshot rows keyed by date, model and scope; the global scope's NULL id matches itself."""
    keys = ["calculation_date", "model_id", "scope_type", "scope_id"]
    return prefer_new(rankings, keep_one(rows, keys, []), keys, [c for c in rows.columns if c not in keys], nullable=["scope_id"])


def upsert_series_pseudo(pseudo: DataFrame, rows: DataFrame) -> DataFrame:
    keys = ["round_id", "series_id"]
    return prefer_new(pseudo, keep_one(rows, keys, []), keys, [c for c in rows.columns if c not in keys])


def upsert_definitions(definitions: DataFrame, rows: DataFrame) -> DataFrame:
    """Every given attribute but the id, by schedule."""
    return prefer_new(definitions, keep_one(rows, ["schedule_id"], []), ["schedule_id"], [c for c in rows.columns if c not in ("schedule_id", "id")])


def resolve_categories(category: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category ids for (domain, category, subcategory) texts, empty text counting as NULL.

    Returns the rows with ``category_id`` and the categories to add. A new id is a hash of the
    natural key, so no counter is shared between tasks.
    """
    blank = {c: F.nullif(F.col(c), F.lit("")) for c in ("category", "subcategory")}
    clean = rows.withColumns(blank)
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("domain", "category", "subcategory")]
    new_id = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")
    known = category.select(
        F.col("id").alias("_id"), F.col("domain").alias("_d"), F.col("category").alias("_c"), F.col("subcategory").alias("_s")
    )
    match = (
        (F.col("domain") == F.col("_d"))
        & F.col("category").eqNullSafe(F.col("_c"))
        & F.col("subcategory").eqNullSafe(F.col("_s"))
    )
    joined = clean.join(known, match, "left")
    resolved = joined.withColumn("category_id", F.coalesce(F.col("_id"), new_id)).drop("_id", "_d", "_c", "_s")
    added = (
        joined.filter(F.col("_id").isNull())
        .select(new_id.alias("id"), "domain", "category", "subcategory")
        .distinct()
    )
    return resolved, added


def upsert_catalogue(series: DataFrame, rows: DataFrame) -> DataFrame:
    """Seven attributes by unique_id. A known series keeps its id; ``rows`` carries ids for new ones."""
    attributes = ["name", "description", "frequency_s", "unit", "update_frequency", "imputation_policy", "category_id"]
    return prefer_new(series, keep_one(rows, ["unique_id"], []), ["unique_id"], attributes)


def update_timezone(series: DataFrame, rows: DataFrame) -> DataFrame:
    """Set ts_timezone where it is missing or different."""
    new = keep_one(rows.select("unique_id", F.col("ts_timezone").alias("_tz")), ["unique_id"], [])
    differs = F.col("_tz").isNotNull() & ~F.col("ts_timezone").eqNullSafe(F.col("_tz"))
    return (
        series.join(new, "unique_id", "left")
        .withColumn("ts_timezone", F.when(differs, F.col("_tz")).otherwise(F.col("ts_timezone")))
        .select(*series.columns)
    )


def create_rounds_if_absent(rounds: DataFrame, rows: DataFrame) -> DataFrame:
    return insert_ignore(rounds, rows, ["name"], ["created_at"])


def cancel_rounds(rounds: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select(F.col("id"), F.lit(True).alias("_hit")).distinct()
    return rounds.join(hit, "id", "left").withColumn(
        "is_cancelled", F.coalesce(F.col("_hit"), F.col("is_cancelled"))
    ).select(*rounds.columns)


def update_round_times(rounds: DataFrame, rows: DataFrame) -> DataFrame:
    """Given start and end times replace the old ones; NULL leaves a side as it was."""
    new = keep_one(rows.select("id", F.col("start_time").alias("_s"), F.col("end_time").alias("_e")), ["id"], [])
    return (
        rounds.join(new, "id", "left")
        .withColumns({
            "start_time": F.coalesce(F.col("_s"), F.col("start_time")),
            "end_time": F.coalesce(F.col("_e"), F.col("end_time")),
        })
        .select(*rounds.columns)
    )


def finalise_scores(scores: DataFrame, round_ids: DataFrame) -> DataFrame:
    hit = round_ids.select("round_id", F.lit(True).alias("_hit")).distinct()
    return scores.join(hit, "round_id", "left").withColumn(
        "final_evaluation", F.coalesce(F.col("_hit"), F.col("final_evaluation"))
    ).select(*scores.columns)


def delete_forecasts(forecasts: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining rows and deleted counts. ``doomed`` has round_id, model_id and an optional series_id."""
    keys = ["round_id", "model_id"] + (["series_id"] if "series_id" in doomed.columns else [])
    wanted = doomed.select(*keys).distinct()
    kept = forecasts.join(wanted, keys, "left_anti")
    deleted = forecasts.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("deleted"))
    return kept, deleted


def apply_retention(points: DataFrame, as_of: datetime | str, years: int = 5) -> DataFrame:
    oldest = instant(as_of) - F.make_interval(years=F.lit(years))
    return points.filter(F.col("ts") >= oldest)


def register_models(models: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """New (user_id, name) pairs; only internal users may name another organisation."""
    owner = users.select(
        F.col("id").alias("user_id"), F.col("organization_id").alias("_own"), F.col("user_type").alias("_type")
    )
    organisation = F.when(
        (F.coalesce(F.col("_type"), F.lit("external")) == "internal") & F.col("organization_id").isNotNull(),
        F.col("organization_id"),
    ).otherwise(F.col("_own"))
    owned = requests.join(owner, "user_id").withColumn("organization_id", organisation).drop("_own", "_type")
    order = ["requested_at"] if "requested_at" in requests.columns else []
    return insert_ignore(models, owned, ["user_id", "name"], order)
