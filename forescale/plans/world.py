"""The data model bound to the given tables.

Events become points twice: as one series per event type (few, hot) and one per user (many).
Rounds, context, forecasts, history and submissions follow from them with the library's own
operators. Tables that a deployment stores are written once per session to the shared folder
and read from there; everything grows with the given tables.
"""

from __future__ import annotations

import hashlib
from datetime import date, datetime, timedelta
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forescale.functions.durations import RESOLUTION_SECONDS, resolution_of
from forescale.functions.times import instant, shift
from forescale.operators import forecasts as fc
from forescale.operators import ranking, rollup, rounds, scoring
from forescale.operators.elo import daily_rankings
from forescale.plans import lifecycle
from forescale.session import configure, shared_dir, small_table

SEED = 42
AS_OF = datetime(2024, 1, 25)
REGISTRATION_AS_OF = datetime(2024, 1, 20, 6, 30)
LATE = datetime(2024, 2, 2)
SNAPSHOTS = [date(2024, 1, 20), date(2024, 1, 25), date(2024, 1, 31)]
USER_BASE = 100_000
IDLE = 6

# Series of the event types, small dimension rows.
TYPES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
TYPE_CATEGORY = {1: 1, 2: 2, 3: 3, 4: 3, 5: 1}
CATEGORIES = [
    (1, "traffic", "online", "web", "visits"),
    (2, "quality", "online", "web", "faults"),
    (3, "sales", "online", "shop", "orders"),
]
DEFINITIONS = [
    (1, "s-hourly-day", "Hourly day", [], [], [], [], 101, 86400, 3600, 3600, 5, True),
    (2, "s-hourly-3day", "Hourly three days", ["traffic", "quality", "sales"], ["mixed"], [], [], 101, 259200, 3600, 3600, 3, True),
    (3, "s-quarter-day", "Quarter-hour day", ["traffic", "sales"], ["online"], [], [], 199, 86400, 900, None, 3, True),
    (4, "s-daily", "Daily three days", ["people"], [], ["users"], [], 7, 259200, 86400, 3600, None, False),
]
DEFINITION_SCHEMA = (
    "id int, schedule_id string, name string, domains array<string>, subdomains array<string>, categories array<string>, "
    "subcategories array<string>, context_length int, horizon_s long, frequency_s long, registration_s long, "
    "n_time_series int, is_active boolean"
)
MODELS = [
    (1, 1, 1, "Persistence", "persistence-1", "statistical", "naive", "none", 0),
    (2, 1, 1, "Seasonal", "seasonal-2", "statistical", "naive", "none", 0),
    (3, 2, 2, "Mean", "mean-3", "statistical", "mean", "none", 1),
    (4, 2, None, "Noisy", "noisy-4", "oracle", "noise", "none", 9),
]
MODEL_SCHEMA = (
    "id int, user_id int, organization_id int, name string, readable_id string, model_type string, model_family string, "
    "architecture string, model_size int"
)
USERS = [(1, "ada", 1, "internal"), (2, "bo", 2, "external")]
ORGANISATIONS = [(1, "North"), (2, "South")]


class World:
    """Lazily built tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")
        self.landed: set[str] = set()
        tag = hashlib.md5(self.folder.encode()).hexdigest()[:12]
        self.stage_root = f"{shared_dir(spark)}/forescale/{spark.sparkContext.applicationId}/{tag}"

    def table(self, name: str) -> DataFrame:
        """A given table with its instants as UTC timestamps."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        stamps = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
        return df.withColumns(stamps) if stamps else df

    def stage(self, name: str, df: DataFrame, *partitions: str) -> DataFrame:
        """Writes a stored table and reads it back."""
        path = f"{self.stage_root}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # Given rows as points

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def event_days(self) -> tuple[date, date]:
        """First and last day with events; 13 days from the first of 2024 where there are none."""
        first, last = self.events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
        return (first, max(last, first + timedelta(days=13))) if first else (date(2024, 1, 1), date(2024, 1, 14))

    @property
    def span(self) -> tuple[datetime, datetime]:
        """From the first midnight of the events to the midnight after the last."""
        first, last = self.event_days
        return datetime(first.year, first.month, first.day), datetime(last.year, last.month, last.day) + timedelta(days=1)

    @staticmethod
    def type_series():
        """Number of the event's type: the known ones fixed, any other from its name, between those and the users."""
        digits = F.conv(F.substring(F.md5("event_type"), 1, 8), 16, 10).cast("long")
        picked = (F.lit(10) + digits % (USER_BASE - 10)).cast("int")
        for name, number in TYPES.items():
            picked = F.when(F.col("event_type") == name, F.lit(number)).otherwise(picked)
        return picked

    @cached_property
    def points(self) -> DataFrame:
        both = F.array(self.type_series(), (F.col("user_id") + USER_BASE).cast("int"))
        return self.events.select(F.explode(both).alias("series_id"), "ts", "value", "event_id")

    @cached_property
    def point_frequency(self) -> DataFrame:
        """Points with their series' native step."""
        step = F.when(F.col("series_id") < USER_BASE, 900).otherwise(86400).cast("long")
        return self.points.withColumn("frequency_s", step)

    # Dimensions

    @cached_property
    def category(self) -> DataFrame:
        fixed = small_table(self.spark, CATEGORIES, "id long, domain string, subdomain string, category string, subcategory string")
        regions = self.table("region").select(
            (F.col("r_regionkey") + 10).cast("long").alias("id"), F.lit("people").alias("domain"), F.lit(None).cast("string").alias("subdomain"),
            F.lit("users").alias("category"), F.lower("r_name").alias("subcategory"),
        )
        return fixed.unionByName(regions)

    @cached_property
    def series(self) -> DataFrame:
        category = F.create_map(*[F.lit(x) for pair in TYPE_CATEGORY.items() for x in pair])
        types = self.events.select("event_type").distinct().select(
            self.type_series().alias("series_id"), F.col("event_type").alias("name"), F.concat(F.lit("ev-"), "event_type").alias("unique_id"),
            F.lit("events").alias("unit"), F.lit(900).cast("long").alias("frequency_s"),
        ).withColumn("category_id", F.coalesce(F.try_element_at(category, F.col("series_id")), F.lit(3)).cast("long"))
        users = self.events.select("user_id").distinct().select(
            (F.col("user_id") + USER_BASE).cast("int").alias("series_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"),
            F.concat(F.lit("us-"), F.col("user_id").cast("string")).alias("unique_id"), F.lit("money").alias("unit"),
            F.lit(86400).cast("long").alias("frequency_s"), (F.col("user_id") % 5 + 10).cast("long").alias("category_id"),
        )
        idle = small_table(self.spark, [(IDLE, "idle", "ev-idle", "events", 900, 1)], "series_id int, name string, unique_id string, unit string, frequency_s long, category_id long")
        return types.unionByName(users).unionByName(idle).withColumns({
            "description": F.concat(F.lit("about "), "name"), "ts_timezone": F.lit("UTC"), "update_frequency": F.lit("15 minutes"),
        })

    @cached_property
    def definitions(self) -> DataFrame:
        return small_table(self.spark, DEFINITIONS, DEFINITION_SCHEMA)

    @cached_property
    def assignments(self) -> DataFrame:
        """Versioned series assignments; the per-user definition takes every user."""
        schema = "definition_id int, series_id int, is_required boolean, is_excluded boolean, valid_from timestamp, valid_to timestamp, is_current boolean"
        begin, closed = datetime(2024, 1, 1), datetime(2024, 1, 5)
        fixed = [(1, s, True, s == 3, begin, None, True) for s in range(1, 6)]
        fixed += [(2, s, True, False, begin, None, True) for s in range(1, 4)] + [(2, 4, True, False, begin, closed, False)]
        users = self.events.select("user_id").distinct().select(
            F.lit(4).alias("definition_id"), (F.col("user_id") + USER_BASE).cast("int").alias("series_id"), F.lit(True).alias("is_required"),
            (F.col("user_id") % 10 == 7).alias("is_excluded"), instant(begin).alias("valid_from"),
            F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"),
        )
        return small_table(self.spark, fixed, schema).unionByName(users)

    @cached_property
    def models(self) -> DataFrame:
        return small_table(self.spark, MODELS, MODEL_SCHEMA)

    @cached_property
    def users(self) -> DataFrame:
        return small_table(self.spark, USERS, "id int, username string, organization_id int, user_type string")

    @cached_property
    def organisations(self) -> DataFrame:
        return small_table(self.spark, ORGANISATIONS, "id int, name string")

    # Stored tables

    @cached_property
    def rollups(self) -> DataFrame:
        return self.stage("rollups", rollup.rollup_all(self.points), "resolution")

    @cached_property
    def created(self) -> DataFrame:
        """Rounds as created: every definition on each morning that events follow, with history before and a window after."""
        first, last = self.event_days
        day = F.explode(F.sequence(F.lit(first + timedelta(days=9)), F.lit(last - timedelta(days=4)))).alias("day")
        seen = self.events.select(F.to_date("ts").alias("day")).distinct()
        starts = self.definitions.select(F.col("id").alias("definition_id"), day).join(seen, "day", "left_semi").select(
            "definition_id", (F.col("definition_id") * 10_000 + F.date_diff("day", F.lit(first)) + 1).cast("int").alias("id"),
            shift(F.col("day").cast("timestamp"), 6 * 3600).alias("registration_start"),
        )
        return rounds.create_rounds(self.definitions, starts).withColumn("is_cancelled", F.col("id") % 37 == 0)

    @cached_property
    def chosen(self) -> DataFrame:
        picked = lifecycle.choose(self.created, self.definitions, self.assignments, self.series, self.category, self.points, AS_OF, SEED)
        return self.stage("chosen", picked)

    @cached_property
    def served(self) -> DataFrame:
        """Rollup rows of the series that rounds chose, at the resolutions of those rounds: all that context, forecasts and scores look up.

        The series asked for are stored by resolution, so a resolution that few series need is not shuffled.
        """
        asked = self.stage("asked", rounds.asked_levels(self.created, self.chosen))
        kept = []
        for level in RESOLUTION_SECONDS:
            series = self.stage(f"asked-{level}", asked.filter(F.col("resolution") == level).select("series_id"))
            kept.append(self.rollups.filter(F.col("resolution") == level).join(series, "series_id", "left_semi"))
        rows = reduce(DataFrame.unionByName, kept).select("resolution", "series_id", "ts", "value")
        return self.stage("served", rows, "resolution")

    @cached_property
    def context(self) -> DataFrame:
        return self.stage("context", rounds.context_snapshot(self.created, self.chosen, self.served))

    @cached_property
    def pseudo(self) -> DataFrame:
        return self.stage("pseudo", rounds.series_pseudonyms(self.chosen, self.series, self.context))

    @cached_property
    def rounds(self) -> DataFrame:
        return self.stage("rounds", rounds.retime_rounds(self.created, self.pseudo))

    @cached_property
    def forecasts(self) -> DataFrame:
        """Four models: persistence, seasonal, context mean, and the actual with noise."""
        lag = F.when(F.col("frequency_s") < 86400, 86400).otherwise(7 * 86400)
        levels = self.rounds.select(F.col("id").alias("round_id"), "frequency_s", "registration_start", resolution_of(F.col("frequency_s")).alias("resolution"))
        means = self.pseudo.select("round_id", "series_id", "value_avg")
        base = fc.naive_forecast(self.rounds, self.context).join(means, ["series_id", "round_id"])
        base = base.join(levels, "round_id").withColumn("_before", shift(F.col("ts"), -lag))
        values = self.served.select("resolution", "series_id", "ts", "value")
        before = values.select("resolution", "series_id", F.col("ts").alias("_before"), F.col("value").alias("_seasonal"))
        joined = base.join(before, ["series_id", "_before", "resolution"], "left").join(values, ["series_id", "ts", "resolution"], "left")
        noise = 1 + ((F.col("round_id") * 31 + F.col("series_id") * 7 + F.hour("ts")) % 11 - 5) / 50.0
        made = {
            1: F.col("predicted_value"),
            2: F.coalesce("_seasonal", "predicted_value"),
            3: F.when(F.col("round_id") % 5 != 0, F.col("value_avg")),
            4: F.col("value") * noise,
        }
        each = F.array(*[F.struct(F.lit(m).alias("model_id"), v.alias("predicted_value")) for m, v in made.items()])
        rows = joined.select("round_id", "series_id", "ts", "registration_start", F.explode(each).alias("m"))
        value = F.col("m.predicted_value")
        levels = F.create_map(F.lit("0.025"), value * 0.9, F.lit("0.5"), value, F.lit("0.975"), value * 1.1)
        forecasts = rows.filter(value.isNotNull()).select(
            "round_id", "m.model_id", "series_id", "ts", "m.predicted_value", shift(F.col("registration_start"), F.col("m.model_id") * 60).alias("created_at"),
            F.when(F.col("m.model_id") % 2 == 0, levels).alias("probabilistic_values"),
        )
        return self.stage("forecasts", forecasts)

    def _scores(self, name: str, as_of: datetime) -> DataFrame:
        rows = scoring.evaluate(self.forecasts, self.rounds, self.pseudo, self.served, as_of)
        return self.stage(name, rows.withColumn("calculated_at", instant(as_of)))

    @cached_property
    def scores(self) -> DataFrame:
        return self._scores("scores", AS_OF)

    @cached_property
    def late_scores(self) -> DataFrame:
        """Scores after every window and time-out."""
        return self._scores("late_scores", LATE)

    @cached_property
    def sums(self) -> DataFrame:
        return self.stage("sums", ranking.round_model_scores(self.late_scores, self.rounds, self.definitions, self.assignments))

    @cached_property
    def averages(self) -> DataFrame:
        return ranking.round_averages(self.late_scores, self.rounds, self.definitions, self.assignments)

    @cached_property
    def rankings(self) -> DataFrame:
        return self.stage("rankings", daily_rankings(self.averages, self.sums, self.rounds, SNAPSHOTS, seed=SEED))

    @cached_property
    def board(self) -> DataFrame:
        return ranking.leaderboard(self.rankings, self.models, self.users, self.organisations, self.definitions)

    @cached_property
    def history(self) -> DataFrame:
        """Versions: known an hour late; every error event first 3 percent low, corrected after a day."""
        fixed = F.col("event_type") == "error"
        both = F.array(self.type_series(), (F.col("user_id") + USER_BASE).cast("int"))
        first = F.struct(
            F.when(fixed, F.col("value") * 0.97).otherwise(F.col("value")).alias("value"), shift(F.col("ts"), 3600).alias("valid_from"),
            F.when(fixed, shift(F.col("ts"), 86400)).alias("valid_to"), (~fixed).alias("is_current"),
        )
        second = F.when(fixed, F.struct(
            F.col("value").alias("value"), shift(F.col("ts"), 86400).alias("valid_from"),
            F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"),
        ))
        versions = self.events.select("ts", F.explode(both).alias("series_id"), F.array_compact(F.array(first, second)).alias("_v"))
        return versions.select("series_id", "ts", F.explode("_v").alias("v")).select(
            "series_id", "ts", "v.value", F.lit(0).cast("short").alias("quality_code"), "v.valid_from", "v.valid_to", "v.is_current"
        )

    @cached_property
    def submissions(self) -> DataFrame:
        """Forecasts as uploads with planted faults: names, missing and doubled points, owners, times, rounds."""
        owners = self.models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"), "user_id")
        windows = self.rounds.select(F.col("id").alias("round_id"), "registration_start", "registration_end", "start_time")
        names = self.pseudo.select("round_id", "series_id", "challenge_series_name")
        r, s, m = F.col("round_id"), F.col("series_id"), F.col("model_id")
        first = F.col("ts") == F.col("start_time")
        rows = self.forecasts.join(owners, "model_id").join(windows, "round_id").join(names, ["round_id", "series_id"])
        copies = F.when(first & ((r * 3 + s + m) % 7 == 0), 0).when(first & ((r * 5 + s + m) % 19 == 0), 2).otherwise(1)
        sent = F.when((r + m) % 13 == 0, shift(F.col("registration_end"), 3600)).when(
            (r + m) % 23 == 0, shift(F.col("registration_start"), -3600)
        ).otherwise(shift(F.col("registration_start"), 600))
        uploads = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(
            F.when((r * 2 + m) % 29 == 0, r + 1_000_000).otherwise(r).alias("round_id"), "model_name",
            F.when((r + m) % 17 == 0, 3 - F.col("user_id")).otherwise(F.col("user_id")).alias("user_id"),
            F.when((r + s + m) % 11 == 0, F.concat(F.lit("nope_"), s.cast("string"))).otherwise(F.col("challenge_series_name")).alias("challenge_series_name"),
            "ts", F.col("predicted_value").alias("value"), sent.alias("submitted_at"), "probabilistic_values",
        )
        return self.stage("submissions", uploads)

    @cached_property
    def price_events(self) -> DataFrame:
        """Events as price changes of ten stations and three fuels."""
        fuel = F.when(F.col("event_type").isin("click", "signup"), "e5").when(F.col("event_type") == "view", "e10").otherwise("diesel")
        return self.events.select(
            F.concat(F.lit("st-"), (F.col("user_id") % 10).cast("string")).alias("station"), fuel.alias("fuel"), "ts",
            F.round(1 + F.floor(F.col("value") / 50) / 10, 2).alias("price"),
        )


_worlds: dict[tuple[str, str], World] = {}


def world(spark: SparkSession, folder: str) -> World:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _worlds:
        _worlds[key] = World(spark, folder)
    return _worlds[key]
