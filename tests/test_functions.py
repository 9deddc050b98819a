from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from forescale.functions import durations, numeric, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("words, seconds", [
    ("PT1H", 3600), ("P1D", 86400), ("PT15M", 900), ("P1W", 604800), ("P1DT2H", 93600), ("15 minutes", 900), ("1 hour", 3600),
    ("7 Days", 604800), (" 30 seconds ", 30), ("2 weeks", 1209600), ("1hour", 3600),
])
def test_parse_seconds(spark, words, seconds):
    assert one(spark, durations.parse_seconds(F.lit(words))) == seconds


@pytest.mark.parametrize("words", ["", "soon", "P", "PT", "1 fortnight", "-1 day", "1.5 hours"])
def test_bad_duration(spark, words):
    assert one(spark, durations.parse_seconds(F.lit(words), strict=False)) is None
    with pytest.raises(PySparkException):
        one(spark, durations.parse_seconds(F.lit(words)))


def test_missing_duration_is_null(spark):
    assert one(spark, durations.parse_seconds(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("seconds, iso, db", [
    (900, "PT15M", "00:15:00"), (3600, "PT1H", "01:00:00"), (86400, "P1D", "1 day"), (259200, "P3D", "3 days"),
    (93600, "P1DT2H", "1 day 02:00:00"), (0, "P0D", "00:00:00"), (61, "PT1M1S", "00:01:01"),
])
def test_duration_texts(spark, seconds, iso, db):
    value = F.lit(seconds).cast("long")
    assert one(spark, durations.iso_text(value)) == iso
    assert one(spark, durations.db_text(value)) == db
    assert one(spark, durations.db_text_seconds(F.lit(db))) == seconds


def test_resolution_and_scope(spark):
    assert one(spark, durations.resolution_of(F.lit(900))) == "15min"
    assert one(spark, durations.resolution_of(F.lit(300))) == "1h"
    assert one(spark, durations.resolution_of(F.lit(300), "raw")) == "raw"
    assert one(spark, durations.scope_id(F.lit(900), F.lit(86400))) == "00:15:00::1 day"
    assert one(spark, durations.expected_points(F.lit(86400), F.lit(3600))) == 24
    assert one(spark, durations.expected_points(F.lit(86400), F.lit(0))) is None


def test_comma_list(spark):
    assert one(spark, text.comma_list(F.lit("Energy, Finance"))) == ["Energy", "Finance"]
    assert one(spark, text.comma_list(F.lit("a,, b ,"))) == ["a", "b"]
    assert one(spark, text.comma_list(F.lit(None).cast("string"))) is None
    assert one(spark, text.comma_list(F.lit(""))) is None


def test_percent_goes_to_even(spark):
    assert one(spark, text.percent(F.lit(0.5625))) == "56.2%"
    assert one(spark, text.percent(F.lit(0.9375))) == "93.8%"


def test_pseudonym(spark):
    import hashlib

    assert one(spark, text.pseudonym(F.lit(1), F.lit(2))) == "series_" + hashlib.sha1(b"1:2").hexdigest()[:12]


def test_zero_baseline(spark):
    assert one(spark, numeric.stored_mase(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, numeric.stored_mase(F.lit(1.0), F.lit(0.0))) == float("inf")
    assert one(spark, numeric.stored_mase(F.lit(1.0), F.lit(2.0))) == 0.5
    assert one(spark, numeric.live_mase(F.lit(1.0), F.lit(0.0), F.lit(3))) is None
    assert one(spark, numeric.live_mase(F.lit(1.0), F.lit(2.0), F.lit(0))) is None


def test_finite(spark):
    for value, kept in ((1.5, 1.5), (float("inf"), None), (float("-inf"), None), (float("nan"), None)):
        assert one(spark, numeric.finite_or_null(F.lit(value))) == kept


def test_spread(spark):
    assert one(spark, numeric.spread(F.lit(6.0), F.lit(14.0), F.lit(3))) == pytest.approx((2 / 3) ** 0.5)
    assert one(spark, numeric.spread(F.lit(6.0), F.lit(36.0), F.lit(1))) is None
    assert one(spark, numeric.spread(F.lit(6.0), F.lit(12.0), F.lit(3))) is None


@pytest.mark.parametrize("text_, moment", [
    ("2024-01-01T00:00Z", datetime(2024, 1, 1)), ("2024-01-01T05", datetime(2024, 1, 1, 5)), ("2024-01-01", datetime(2024, 1, 1)),
    ("2024-01-01T01:00:00+01:00", datetime(2024, 1, 1)), ("soon", None),
])
def test_read_instant(spark, text_, moment):
    assert one(spark, times.read_instant(F.lit(text_))) == moment


def test_local_time(spark):
    summer = times.local_to_utc(F.to_timestamp(F.lit("2024-10-27 02:30:00")), "Europe/Berlin")
    winter = times.local_to_utc(F.to_timestamp(F.lit("2024-01-10 02:30:00")), "Europe/Berlin")
    assert one(spark, summer) == datetime(2024, 10, 27, 0, 30)
    assert one(spark, winter) == datetime(2024, 1, 10, 1, 30)


def test_validity_is_half_open(spark):
    day = lambda d: times.instant(datetime(2024, 1, d))
    assert one(spark, times.valid_at(day(1), day(1), day(2))) is True
    assert one(spark, times.valid_at(day(2), day(1), day(2))) is False
    assert one(spark, times.valid_at(day(9), day(1), F.lit(None).cast("timestamp"))) is True


def test_month_end_and_floor(spark):
    assert one(spark, times.is_month_end(F.lit(date(2024, 2, 29)))) is True
    assert one(spark, times.is_month_end(F.lit(date(2024, 2, 28)))) is False
    assert one(spark, times.floor_to(times.instant(datetime(2024, 1, 1, 0, 19, 59)), 600)) == datetime(2024, 1, 1, 0, 10)
