"""Sharding: equal texts stay together, and the largest of the contiguous shards is as small as it can be.

Only DataFrame functions touch rows. Equal texts form an atomic group; its weight is the sum of its rows' sizes, its place
in the order 60 bits of the text's MD5, which spreads any order of the input evenly over the shards. A binary search finds
the smallest capacity with which going through the groups and opening a shard whenever the next group doesn't fit needs no
more than the given number of shards; a group that alone is above it, such as one with a third of all bytes, has its own.
With that capacity the cuts are made, each as near below an equal share of what is left as the rest allows.

The search asks only where the last group boundary below a number of bytes lies. It is answered from sums over ranges
of the order: ``RANGES`` at first, and only the ranges in which an answer lies are cut into ``PARTS`` parts each and
summed anew, all that one pass asks for in one job, until every answer is an exact boundary. The driver holds those sums
alone, whatever the number of rows: a pass asks for some hundreds of ranges and their depth is the logarithm of the rows.

A row's shard follows from its text and the cuts, without a join. Rows are numbered within slices of a hash of doc_id and
text, after equal rows are counted as one, so that no slice is large; sums of the slices' rows make the numbers gapless.

Defined results: a null text is as an empty one and has size 1; rows with a null doc_id are sharded like others; equal
rows get a slot each; an empty table has no rows. With fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forescale.llm.common import BROADCAST_NUMBERS, staged

BITS = 60
RANGES = 10  # bits of the first ranges
PARTS = 6  # bits by which a range is cut
SLICE_ROWS = 50_000


def order_key(text: Column) -> Column:
    """60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


@dataclass
class Range:
    """Groups whose keys begin alike: the first and last key, their bytes and the heaviest group."""

    first: int
    last: int
    weight: int
    heaviest: int
    bits: int

    @property
    def whole(self) -> bool:
        return self.first == self.last


#: Sums of the groups by the first bits of their keys: of all, or of those with one of some prefixes of other length.
Sums = Callable[[int, tuple[int, list[int]] | None], list[Range]]


def sums_of(groups: DataFrame) -> Sums:
    """Sums over ``groups`` (key, weight), one job each."""

    def sums(bits: int, within: tuple[int, list[int]] | None) -> list[Range]:
        rows = groups if within is None else groups.where(F.shiftright("key", BITS - within[0]).isin(within[1]))
        found = rows.groupBy(F.shiftright("key", BITS - bits).alias("prefix")).agg(F.min("key"), F.max("key"), F.sum("weight"), F.max("weight"))
        return [Range(first, last, weight, heaviest, bits) for _, first, last, weight, heaviest in found.collect()]

    return sums


class Order:
    """The groups in order, known by ranges that are refined where a boundary inside one is asked for."""

    def __init__(self, sums: Sums):
        self.sums = sums
        self.missing: set[int] = set()
        self._set(sums(RANGES, None))

    def _set(self, ranges: list[Range]) -> None:
        self.ranges = sorted(ranges, key=lambda r: r.first)
        self.ends = [0]
        for r in self.ranges:
            self.ends.append(self.ends[-1] + r.weight)
        self.total = self.ends[-1]
        self.heaviest = max((r.heaviest for r in self.ranges), default=0)

    def below(self, size: int) -> int:
        """Last boundary at or below ``size`` bytes. Inside an unrefined range: noted, and at least so much."""
        if size >= self.total:
            return self.total
        i = bisect_right(self.ends, size) - 1
        if self.ends[i] == size or self.ranges[i].whole:
            return self.ends[i]
        self.missing.add(i)
        return max(self.ends[i], size - self.ranges[i].heaviest + 1)

    def above(self, size: int) -> int:
        """First boundary at or above ``size`` bytes. Inside an unrefined range: noted, and at most so much."""
        if size <= 0:
            return 0
        i = bisect_right(self.ends, size - 1) - 1
        if self.ranges[i].whole:
            return self.ends[i + 1]
        if size == self.ends[i + 1]:
            return size
        self.missing.add(i)
        return min(self.ends[i + 1], size + self.ranges[i].heaviest - 1)

    def key_at(self, boundary: int) -> int:
        """First key behind a boundary; one beyond all keys at the end."""
        i = bisect_right(self.ends, boundary) - 1
        return self.ranges[i].first if i < len(self.ranges) else 1 << BITS

    def refine(self) -> None:
        """Cut the ranges that were missing: those of one depth in one job each."""
        asked = [self.ranges[i] for i in self.missing]
        kept = [r for i, r in enumerate(self.ranges) if i not in self.missing]
        for bits in {r.bits for r in asked}:
            kept += self.sums(min(BITS, bits + PARTS), (bits, [r.first >> (BITS - bits) for r in asked if r.bits == bits]))
        self._set(kept)

    def settled(self, find: Callable[[], list[int]]) -> list[int]:
        """``find()`` once all boundaries that it asks for are exact."""
        while True:
            self.missing.clear()
            found = find()
            if not self.missing:
                return found
            self.refine()


def filled(order: Order, at: int, limit: int) -> int:
    """End of a shard that starts at a boundary: what fits below the capacity, or one group that alone is above it."""
    end = order.below(at + limit)
    return order.above(at + 1) if end <= at < order.total else end


def capacity(order: Order, shards: int) -> int:
    """Smallest capacity with which the groups, taken in order, fill no more than ``shards`` shards.

    A group above the capacity has a shard of its own: it is what the largest shard can't go below, and must not set the
    size of all others.
    """
    low, high = 1, -(-order.total // shards) + order.heaviest
    while low < high:
        middle = (low + high) // 2
        at = 0
        for _ in range(shards):
            at = filled(order, at, middle)
        if at >= order.total:
            high = middle
        else:
            low = middle + 1
    return low


def cut_points(order: Order, shards: int) -> list[int]:
    """Boundaries of the shards in bytes, under the smallest capacity and as even as it allows."""
    limit = capacity(order, shards)
    least = [order.total]
    for _ in range(shards - 1):
        least.append(min(order.above(least[-1] - limit), order.below(max(0, least[-1] - 1))))
    cuts, at = [], 0
    for left, earliest in zip(range(shards, 1, -1), reversed(least[1:])):
        at = max(earliest, filled(order, at, min(limit, -(-(order.total - at) // left))))
        cuts.append(at)
    return cuts


def cut_keys(sums: Sums, shards: int) -> list[int]:
    """First key of each shard but the first."""
    order = Order(sums)
    if not order.total:
        return []
    return [order.key_at(b) for b in order.settled(lambda: cut_points(order, shards))]


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order_key(text).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = staged(rows.groupBy("doc_id", "key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")), "shard-rows")
    groups = staged(rows.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("weight")), "shard-groups")
    cuts = cut_keys(sums_of(groups), shards)
    number = sum(((F.col("key") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    slices = max(1, rows.count() // SLICE_ROWS)
    bits = slices.bit_length()
    place = order_key(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("key").cast("string")))
    placed = rows.withColumns({"shard": number, "place": place}).withColumn("slice", F.shiftright("place", BITS - bits))
    sums = placed.groupBy("shard", "slice").agg(F.sum("copies").alias("n"))
    before = sums.select("shard", "slice", (F.sum("n").over(W.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("before"))
    if slices * shards * 6 <= BROADCAST_NUMBERS:
        before = F.broadcast(before)
    own = W.partitionBy("shard", "slice").orderBy("place", "doc_id", "key", "size").rowsBetween(W.unboundedPreceding, 0)
    ends = placed.withColumn("end", F.sum("copies").over(own)).join(before, ["shard", "slice"])
    start = F.col("before") + F.col("end") - F.col("copies")
    return ends.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(start, start + F.col("copies") - 1)).alias("slot"))
