"""Price events to a regular grid as a stream: keyed state per station and fuel, bins emitted by event-time timers.

The state of a key is its last price, the start of the first bin that is not emitted, and the events from there on. A timer
stands at the end of that bin. When the watermark passes it, all bins that have ended are emitted, filled ones by the rule of
the batch operator and silent ones with the price carried on, and the timer moves to the end of the next one. So bins appear
while a key is silent, as long as any key of the source moves the watermark; a heartbeat without a price does too.

Events may come in any order within ``late``; later ones are dropped. The state holds the events of the bins that are open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from forescale.operators.resample import STEP_S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
BINS = "station string, fuel string, us long, price double"


def bin_price(start: int, events: list[tuple[int, float]], last: float | None) -> tuple[float, float]:
    """Price of a bin with events (instant, price) in order of time, and the last price in it."""
    on_grid = [price for us, price in events if us == start]
    carry = max(on_grid) if on_grid else last
    entered, before = [], last
    for us, price in events:
        if us != start and (before is None or price != before):
            entered.append(price)
        before = price
    known = ([] if carry is None else [carry]) + entered
    return sum(known) / len(known), before


class Bins(StatefulProcessor):
    """Emits (station, fuel, us, price) for every bin that the watermark has passed, from the first price on."""

    def __init__(self, step_s: int):
        self.step = step_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "start long, last double")  # first bin that is not emitted, price before it
        self.open = handle.getListState("open", "us long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(us), float(price)) for part in rows for us, price in zip(part["us"], part["price"]) if price == price and us == us]
        if came:
            self.open.appendList(came)
            if not self.place.exists():
                start = min(came)[0] // self.step * self.step
                self.place.update((start, None))
                self.handle.registerTimer((start + self.step) // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, last = self.place.get()
        until = timerValues.getCurrentWatermarkInMs() * 1000 // self.step * self.step
        waiting = sorted((int(us), float(price)) for us, price in self.open.get())
        bins, at = [], 0
        start = min([start, *[us // self.step * self.step for us, _ in waiting[:1]]])
        while start < until:
            stop = at
            while stop < len(waiting) and waiting[stop][0] < start + self.step:
                stop += 1
            if stop > at:
                price, last = bin_price(start, waiting[at:stop], last)
                bins.append((start, price))
            elif last is not None:
                bins.append((start, last))
            at, start = stop, start + self.step
        self.place.update((start, last))
        self.open.clear()
        if waiting[at:]:
            self.open.put(waiting[at:])
        self.handle.registerTimer((start + self.step) // 1000)
        yield pd.DataFrame({"station": key[0], "fuel": key[1], "us": pd.Series([b for b, _ in bins], dtype="int64"), "price": pd.Series([p for _, p in bins], dtype="float64")})

    def close(self) -> None:
        pass


def binned(events: DataFrame, late: str = "0 seconds", step_s: int = STEP_S) -> DataFrame:
    """Stream of (station, fuel, ts, price) bins from a stream of price events (station, fuel, ts, price)."""
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", late).select("station", "fuel", "ts", F.unix_micros("ts").alias("us"), "price")
    bins = rows.groupBy("station", "fuel").transformWithStateInPandas(Bins(step_s), BINS, "Append", "EventTime")
    return bins.select("station", "fuel", F.timestamp_micros("us").alias("ts"), "price")


def run_bins(events: DataFrame, out: str, checkpoint: str, late: str = "0 seconds", step_s: int = STEP_S) -> StreamingQuery:
    """Bins as Parquet files; timers need the RocksDB state store, which this query alone is started with."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        sink = binned(events, late, step_s).writeStream.outputMode("append").format("parquet").option("path", out)
        return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
