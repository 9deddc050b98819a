"""Durations as whole seconds, and the texts they are read from and shown as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit word, seconds per resolution.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
RESOLUTION_SECONDS = {"15min": 900, "1h": 3600, "1d": 86400}

ISO_SECONDS = {"W": 604800, "D": 86400, "H": 3600, "M": 60, "S": 1}

_ISO = r"^P(?=.)(?:\d+W)?(?:\d+D)?(?:T(?=.)(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$"


def _number(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("long"), F.lit(0))


def parse_seconds(text: Column, strict: bool = True) -> Column:
    """``15 minutes`` or ``PT15M`` to 900. Bad text raises, or is NULL when not strict."""
    trimmed = F.trim(text)
    words = F.lower(trimmed)
    count = F.regexp_extract(words, r"^\d+", 0)
    unit = F.regexp_replace(F.trim(F.substr(words, F.length(count) + 1)), "s$", "")
    seconds = F.create_map(*[F.lit(x) for name, size in UNIT_SECONDS.items() for x in (name, size)])
    by_words = F.when(count != "", count.try_cast("long") * F.try_element_at(seconds, unit).cast("long"))
    letter = F.create_map(*[F.lit(x) for pair in ISO_SECONDS.items() for x in pair])

    def add(total: Column, part: Column) -> Column:
        count = F.substr(part, F.lit(1), F.length(part) - 1).cast("long")
        return total + count * F.element_at(letter, F.right(part, F.lit(1)))

    parts = F.regexp_extract_all(trimmed, F.lit(r"\d+[WDHMS]"), F.lit(0))
    by_iso = F.when(trimmed.rlike(_ISO), F.aggregate(parts, F.lit(0).cast("long"), add))
    if not strict:
        return F.coalesce(by_words, by_iso)
    bad = F.raise_error(F.concat(F.lit("invalid interval: "), text)).cast("long")
    return F.coalesce(by_words, by_iso, F.when(text.isNotNull(), bad))


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("long"))


def _split(seconds: Column) -> tuple[Column, Column, Column, Column]:
    s = seconds.cast("long")
    return _div(s, 86400), _div(s % 86400, 3600), _div(s % 3600, 60), s % 60


def iso_text(seconds: Column) -> Column:
    """900 to ``PT15M``, 86400 to ``P1D``, 93600 to ``P1DT2H``."""
    days, hours, minutes, secs = _split(seconds)

    def part(value: Column, letter: str) -> Column:
        return F.when(value > 0, F.concat(value.cast("string"), F.lit(letter))).otherwise(F.lit(""))

    mark = F.when(seconds % 86400 > 0, F.lit("T")).otherwise(F.lit(""))
    body = F.concat(F.lit("P"), part(days, "D"), mark, part(hours, "H"), part(minutes, "M"), part(secs, "S"))
    return F.when(seconds == 0, F.lit("P0D")).otherwise(body)


def db_text(seconds: Column) -> Column:
    """900 to ``00:15:00``, 86400 to ``1 day``, 93600 to ``1 day 02:00:00``."""
    days, hours, minutes, secs = _split(seconds)
    clock = F.format_string("%02d:%02d:%02d", hours, minutes, secs)
    day_text = F.concat(days.cast("string"), F.when(days == 1, F.lit(" day")).otherwise(F.lit(" days")))
    return (
        F.when(seconds < 86400, clock)
        .when(seconds % 86400 == 0, day_text)
        .when(seconds.isNotNull(), F.concat_ws(" ", day_text, clock))
    )


def db_text_seconds(text: Column) -> Column:
    """Inverse of :func:`db_text`."""
    days, hours = _number(text, r"(\d+) day"), _number(text, r"(\d+):")
    minutes, secs = _number(text, r":(\d+)"), _number(text, r":\d+:(\d+)")
    return days * 86400 + hours * 3600 + minutes * 60 + secs


def scope_id(frequency_s: Column, horizon_s: Column) -> Column:
    """Key of a frequency and horizon scope, such as ``01:00:00::1 day``."""
    return F.concat(db_text(frequency_s), F.lit("::"), db_text(horizon_s))


def resolution_of(frequency_s: Column, default: str | None = "1h") -> Column:
    """Name of the rollup that serves a frequency; scoring falls back to 1h, drill-downs to raw."""
    picked = F.lit(default)
    for name, seconds in RESOLUTION_SECONDS.items():
        picked = F.when(frequency_s == seconds, F.lit(name)).otherwise(picked)
    return picked


def resolution_seconds(resolution: Column) -> Column:
    picked = F.lit(None).cast("long")
    for name, seconds in RESOLUTION_SECONDS.items():
        picked = F.when(resolution == name, F.lit(seconds).cast("long")).otherwise(picked)
    return picked


def expected_points(horizon_s: Column, frequency_s: Column) -> Column:
    """Number of forecast points of one series; NULL when either side is missing or zero."""
    return F.when((horizon_s > 0) & (frequency_s > 0), F.floor(horizon_s / frequency_s).cast("long"))
