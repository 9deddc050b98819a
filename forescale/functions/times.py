"""Instants and dates."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def instant(value: datetime | str) -> Column:
    """Literal UTC instant; a naive datetime or plain text counts as UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(round(value.timestamp() * MICROS)).cast("long"))


# Spellings of instants beside the full ISO form.
SHORT_FORMS = ("yyyy-MM-dd'T'HH:mmX", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HHX", "yyyy-MM-dd'T'HH")


def read_instant(text: Column) -> Column:
    """ISO text to an instant, with or without seconds, minutes and zone; NULL when it is none."""
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(form)) for form in SHORT_FORMS])


def shift(ts: Column, seconds: Column | int) -> Column:
    """Instant moved by whole seconds."""
    step = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(ts) + step.cast("long") * MICROS)


def floor_to(ts: Column, seconds: Column | int) -> Column:
    """Start of the epoch-aligned bucket that holds the instant."""
    width = (F.lit(seconds) if isinstance(seconds, int) else seconds).cast("long") * MICROS
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, width))


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def is_month_end(day: Column) -> Column:
    return F.last_day(day) == day


def valid_at(moment: Column, valid_from: Column, valid_to: Column) -> Column:
    """Half-open validity; an open end lasts for ever."""
    return (valid_from <= moment) & (valid_to.isNull() | (moment < valid_to))


def in_dates(ts: Column, first: str | None, last: str | None) -> Column:
    """Half-open filter from the first day to the end of the last day."""
    kept = F.lit(True)
    if first:
        kept = kept & (ts >= F.to_timestamp(F.lit(first)))
    if last:
        kept = kept & (ts < shift(F.to_timestamp(F.lit(last)), 86400))
    return kept


def local_to_utc(local: Column, zone: str) -> Column:
    """Wall clock to UTC. The doubled autumn hour reads as summer time; the missing spring hour shifts on."""
    return F.to_utc_timestamp(local, zone)
