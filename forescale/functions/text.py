"""Names, lists and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pseudonym(round_id: Column, series_id: Column) -> Column:
    """Stable alias of a sampled series within one round."""
    digest = F.sha1(F.concat_ws(":", round_id.cast("string"), series_id.cast("string")))
    return F.concat(F.lit("series_"), F.substring(digest, 1, 12))


def round_name(definition_name: Column, start: Column) -> Column:
    return F.concat(definition_name, F.lit(" - "), F.date_format(start, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def comma_list(text: Column) -> Column:
    """``"Energy, Finance"`` to an array; blanks dropped, NULL and empty text give NULL."""
    items = F.transform(F.split(text, ","), lambda item: F.trim(item))
    return F.when(F.coalesce(text, F.lit("")) != "", F.filter(items, lambda item: item != ""))


def order_key(seed: int, *parts: Column) -> Column:
    """Repeatable random order: hash of the seed and the ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[part.cast("string") for part in parts]))


def percent(ratio: Column, digits: int = 1) -> Column:
    """Share as text; halves go to the even digit."""
    return F.concat(F.format_string(f"%.{digits}f", F.bround(ratio * 100, digits)), F.lit("%"))
