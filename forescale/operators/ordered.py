"""Ordered operators over time series that stay even when one series, or one hour, holds most rows.

A window over a whole raw series would put that series into one task. Here rows are cut into
calendar chunks, by default minutes within days. Only rows of one minute meet in a window; each
minute leaves one summary row, summaries of one day meet in the next window, and one row per day
reaches the window over the whole key. All three are bounded however many rows arrive: points
are unique per (series, microsecond), so a minute holds at most 60 million of them, a day has
1,440 minutes, and five years have 1,826 days.

Regular grids and rollups are bounded by the calendar already; they pass ``DAYS`` or ``WHOLE``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNKS = ("day", "minute")
DAYS = ("day",)
WHOLE = ()


def unroll(df: DataFrame, last: Column, name: str, width: int = 4096) -> DataFrame:
    """Each row once per ``name`` in 0..last. Long runs unroll in two steps, so no array is long."""
    zero = F.lit(0).cast("long")
    outer = df.withColumn("_last", last.cast("long")).withColumn(
        "_block", F.explode(F.sequence(zero, F.floor(F.col("_last") / width).cast("long")))
    )
    first = F.col("_block") * width
    inner = F.sequence(first, F.least(F.col("_last"), first + (width - 1)))
    return outer.withColumn(name, F.explode(inner)).drop("_last", "_block")


def _before(keys: Sequence[str], order: Sequence[Column | str]) -> W:
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def _cut(df: DataFrame, keys: Sequence[str], ts: str, chunks: Sequence[str], shared: bool) -> tuple[DataFrame, str]:
    """Rows with the start of their finest chunk, under a name of its own per level.

    ``shared`` rows are summaries that a window and the next summary both read: one explicit
    exchange serves both, so the summaries are computed once. For that both must read the same
    columns and filters, hence the left joins below and sums that look at the instant.
    """
    name = f"_chunk{len(chunks)}"
    cut = df.withColumn(name, F.date_trunc(chunks[-1], F.col(ts)))
    return (cut.repartition(*keys, name) if shared else cut), name


def neighbour(
    df: DataFrame, keys: Sequence[str], ts: str, cols: dict[str, str], after: bool = False, known: bool = False,
    ties: Sequence[str] = (), chunks: Sequence[str] = CHUNKS, shared: bool = False,
) -> DataFrame:
    """Adds columns of the row before (or after) of the same key; ``cols`` maps new name to source.

    With ``known`` each column is the nearest one that is not NULL.
    """
    keys = list(keys)
    order = [F.desc(ts) if after else F.asc(ts), *ties]
    if not chunks:
        frame = _before(keys, order)
        return df.withColumns({name: F.last(source, ignorenulls=known).over(frame) for name, source in cols.items()})
    cut, chunk = _cut(df, keys, ts, chunks, shared)
    frame = _before([*keys, chunk], order)
    edge = F.min_by if after else F.max_by
    summary = cut.groupBy(*keys, chunk).agg(*[
        edge(source, F.when(F.col(source).isNotNull(), F.col(ts)) if known else F.col(ts)).alias(f"_e{len(chunks)}_{name}")
        for name, source in cols.items()
    ])
    carried = neighbour(
        summary, keys, chunk, {f"_c{len(chunks)}_{name}": f"_e{len(chunks)}_{name}" for name in cols}, after, known, (), chunks[:-1], True
    ).select(*keys, chunk, *[f"_c{len(chunks)}_{name}" for name in cols])
    seen = {f"_s{len(chunks)}_{name}": F.last(source, ignorenulls=known).over(frame) for name, source in cols.items()}
    joined = cut.withColumns({"_inside": F.last(F.lit(True)).over(frame), **seen}).join(carried, [*keys, chunk], "left")

    def nearest(name: str) -> Column:
        near, far = F.col(f"_s{len(chunks)}_{name}"), F.col(f"_c{len(chunks)}_{name}")
        return F.coalesce(near, far) if known else F.when(F.col("_inside"), near).otherwise(far)

    return joined.select(*df.columns, *[nearest(name).alias(name) for name in cols])


def running_total(
    df: DataFrame, keys: Sequence[str], ts: str, value: str | None, name: str, after: bool = False,
    chunks: Sequence[str] = CHUNKS, shared: bool = False,
) -> DataFrame:
    """Adds the sum of ``value`` (or count of rows) over all rows before (or after) of the key."""
    keys = list(keys)
    order = [F.desc(ts) if after else F.asc(ts)]
    amount = F.lit(1) if value is None else F.col(value)
    if not chunks:
        return df.withColumn(name, F.coalesce(F.sum(amount).over(_before(keys, order)), F.lit(0)).cast("long"))
    cut, chunk = _cut(df, keys, ts, chunks, shared)
    own, far = f"_t{len(chunks)}", f"_f{len(chunks)}"
    summary = cut.groupBy(*keys, chunk).agg(F.sum(F.when(F.col(ts).isNotNull(), amount)).alias(own))
    carried = running_total(summary, keys, chunk, own, far, after, chunks[:-1], True).select(*keys, chunk, far)
    near = F.coalesce(F.sum(amount).over(_before([*keys, chunk], order)), F.lit(0))
    joined = cut.withColumn("_near", near).join(carried, [*keys, chunk], "left")
    return joined.select(*df.columns, (F.col("_near") + F.col(far)).cast("long").alias(name))


def number_rows(df: DataFrame, keys: Sequence[str], ts: str, name: str = "pos", chunks: Sequence[str] = CHUNKS) -> DataFrame:
    """1-based position of every row within its key, by time."""
    return running_total(df, keys, ts, None, name, chunks=chunks).withColumn(name, F.col(name) + 1)


def next_row(df: DataFrame, keys: Sequence[str], ts: str, cols: dict[str, str], chunks: Sequence[str] = CHUNKS) -> DataFrame:
    """Adds columns of the following row of the same key."""
    return neighbour(df, keys, ts, cols, after=True, chunks=chunks)


def last_n(df: DataFrame, keys: Sequence[str], ts: str, n: int, chunks: Sequence[str] = CHUNKS) -> DataFrame:
    """The newest ``n`` rows of every key.

    Chunk counts tell from which chunk on rows can still be among the last ``n``; older chunks
    never reach a ranking.
    """
    keys = list(keys)
    cut, chunk = _cut(df, keys, ts, chunks, False)
    counts = cut.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
    wanted = running_total(counts, keys, chunk, "_n", "_newer", True, chunks[:-1], True).filter(F.col("_newer") < n)
    inside = W.partitionBy(*keys, chunk).orderBy(F.desc(ts))
    return (
        cut.join(wanted.select(*keys, chunk, "_newer"), [*keys, chunk])
        .withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_newer") + F.col("_rn") <= n)
        .select(*df.columns)
    )


def as_of_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, cols: Sequence[str],
    chunks: Sequence[str] = CHUNKS,
) -> DataFrame:
    """Every left row with ``cols`` of the newest right row at or before it (NULL when none).

    ``cols`` are struct-packed, so a NULL in the newest right row is not skipped.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in cols])
    payload_type = right.select(payload.alias("p")).schema["p"].dataType
    row = F.struct(*[F.col(c) for c in left.columns])
    row_type = left.select(row.alias("r")).schema["r"].dataType
    both = right.select(
        *keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_kind"), payload.alias("_p"), F.lit(None).cast(row_type).alias("_row")
    ).unionByName(left.select(
        *keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_kind"), F.lit(None).cast(payload_type).alias("_p"), row.alias("_row")
    ))
    found = neighbour(both, keys, "_ts", {"_found": "_p"}, known=True, ties=["_kind"], chunks=chunks)
    return found.filter(F.col("_kind") == 1).select("_row.*", *[F.col("_found")[c].alias(c) for c in cols])


def forward_fill(df: DataFrame, keys: Sequence[str], ts: str, value: str, chunks: Sequence[str] = CHUNKS) -> DataFrame:
    """NULLs in ``value`` take the newest earlier value of the key."""
    filled = neighbour(df, keys, ts, {"_before": value}, known=True, chunks=chunks)
    return filled.withColumn(value, F.coalesce(value, "_before")).select(*df.columns)


def changes_only(df: DataFrame, keys: Sequence[str], ts: str, value: str, chunks: Sequence[str] = CHUNKS) -> DataFrame:
    """Rows whose value differs from the previous row of the key; the first row stays."""
    marked = df.withColumn("_row", F.lit(True))
    linked = neighbour(marked, keys, ts, {"_before": value, "_any": "_row"}, chunks=chunks)
    return linked.filter(F.col("_any").isNull() | ~F.col(value).eqNullSafe(F.col("_before"))).select(*df.columns)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = True) -> DataFrame:
    """One row per key, the last or first by ``order``.

    A grouped ``max_by`` combines on the map side, so a key delivered a million times sends one
    row per map task. Whole-row tie-break keeps the result the same on every run.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], *[F.col(c) for c in rest if _sortable(df, c)])
    pick = F.max_by if last else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*[F.col(c) for c in rest]), rank).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def _sortable(df: DataFrame, name: str) -> bool:
    return not df.schema[name].dataType.simpleString().startswith("map")
