"""Series catalogue from nested configuration rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.functions.durations import parse_seconds

# Defaults of missing attributes, sources whose series are electricity.
DEFAULT_FREQUENCY = "1 hour"
DEFAULT_SCHEDULE = "15 minutes"
ELECTRICITY_SOURCES = ("smard", "gridstatus")
ELECTRICITY = "electricity"

METADATA = (
    "struct<name: string, description: string, frequency: string, unit: string, domain: string, subdomain: string, "
    "category: string, subcategory: string, imputation_policy: string, update_frequency: string, schedule: string>"
)
CATALOGUE = f"struct<module: string, group_id: string, timeseries: array<struct<unique_id: string, schedule: string, metadata: {METADATA}>>>"


def load_catalogue(configs: DataFrame) -> DataFrame:
    """Rows of ``payload`` (one source group each) to one row per series with defaults filled in."""
    source = configs.select(F.from_json("payload", CATALOGUE).alias("c")).select(
        F.col("c.module").alias("module"), F.col("c.group_id").alias("group_id"), F.explode("c.timeseries").alias("s")
    ).filter(F.coalesce("s.unique_id", F.lit("")) != "")
    m = "s.metadata."
    named = F.lit(False)
    for word in ELECTRICITY_SOURCES:
        named = named | F.lower("module").contains(word)
    subdomain = F.coalesce(m + "subdomain", F.when(named, F.lit(ELECTRICITY)))
    blank = F.lit("")
    single = F.col("group_id").isNull()
    category = F.when(
        single, F.coalesce(F.nullif(F.col(m + "category"), blank), F.col(m + "subdomain"), blank)
    ).otherwise(F.coalesce(m + "category", blank))
    frequency = F.coalesce(m + "frequency", F.lit(DEFAULT_FREQUENCY))
    update = F.coalesce(
        "s.schedule", F.nullif(F.col(m + "schedule"), blank), F.nullif(F.col(m + "update_frequency"), blank), F.lit(DEFAULT_SCHEDULE)
    )
    return source.select(
        F.col("s.unique_id").alias("unique_id"), "group_id", F.coalesce(m + "name", "s.unique_id").alias("name"),
        F.coalesce(m + "description", blank).alias("description"), parse_seconds(frequency).alias("frequency_s"),
        F.coalesce(m + "unit", blank).alias("unit"), F.coalesce(m + "domain", blank).alias("domain"),
        subdomain.alias("subdomain"), category.alias("category"), F.col(m + "subcategory").alias("subcategory"),
        F.col(m + "imputation_policy").alias("imputation_policy"), update.alias("update_frequency"),
        parse_seconds(update).alias("interval_s"),
    )
