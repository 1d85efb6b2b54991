"""Minimax contiguous partition of documents into shards, in DataFrame operations only.

Equal texts are one atomic group; groups are ordered by the SHA-256 of the
text.  The smallest capacity for which a greedy pass over the ordered groups
needs no more than k shards is found by binary search, and the cuts of that
pass are the shards: contiguous, and no other contiguous cut has a smaller
largest shard.

The driver never holds the groups.  It holds byte sums of ranges of the order
(prefixes of the hash).  With every range taken as divisible the search gives a
lower bound of the capacity, with every range taken as one block an upper
bound; the ranges in which a cut may fall are split by longer prefixes until
the bounds meet.  Each step splits a bounded number of ranges, at any size of
input.

Defined results: a null text counts as empty (size 1); a group larger than an
even share fills a shard of its own and sets the capacity; an empty table gives
no rows; fewer groups than shards leave the last shards empty.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FIRST_DIGITS, MORE_DIGITS = 3, 2


class Range(NamedTuple):
    """A run of groups: the hash prefix they share, their bytes, how many, the largest."""

    prefix: str
    size: int
    groups: int
    largest: int


def _cuts(ends: list[int], capacity: int, k: int) -> list[int] | None:
    """Greedy ends (exclusive indexes) of k shards over blocks with running totals ``ends``; None if they don't suffice."""
    out, at, done = [], 0, 0
    for _ in range(k):
        at = bisect_right(ends, done + capacity, lo=at)
        out.append(at)
        done = ends[at - 1] if at else 0
        if at == len(ends):
            return out
    return None


def _least(feasible, low: int, high: int) -> int:
    """The smallest value from low to high for which the monotone ``feasible`` holds."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def _divisible(ranges: list[Range], starts: list[int], capacity: int, k: int) -> list[int] | None:
    """Greedy byte positions of the cuts if a range of several groups can be cut anywhere."""
    total = starts[-1] + ranges[-1].size
    out, done = [], 0
    for _ in range(k):
        to = done + capacity
        if to >= total:
            return [*out, total]
        i = bisect_right(starts, to) - 1
        if ranges[i].groups == 1:
            to = max(starts[i], done)
        out.append(to)
        done = to
    return None


def plan(ranges: list[Range], k: int, split) -> tuple[int, list[str]]:
    """Capacity and the prefixes at which the second and later shards begin.

    ``split`` takes prefixes and returns the ranges they hold with longer ones.
    """
    if not ranges:
        return 0, []
    total, largest = sum(r.size for r in ranges), max(r.largest for r in ranges)
    while True:
        ranges.sort()
        ends = list(accumulate(r.size for r in ranges))
        starts = [0, *ends[:-1]]
        heavy = [r.prefix for r in ranges if r.groups > 1 and r.size > max(total // (64 * k), 1)]
        if not heavy:
            low = _least(lambda c: _divisible(ranges, starts, c, k) is not None, max(largest, -(-total // k)), total)
            high = _least(lambda c: _cuts(ends, c, k) is not None, low, total)
            if low == high:
                cuts = _cuts(ends, high, k) or []
                return high, [ranges[i].prefix for i in cuts if i < len(ranges)]
            # the j-th cut falls between those of the cautious pass at the low and the free pass at the high capacity
            first, at = [], 0
            for _ in range(k - 1):
                at = bisect_right(ends, (ends[at - 1] if at else 0) + low, lo=at)
                first.append(starts[at] if at < len(ranges) else total)
            free = _divisible(ranges, starts, high, k) or [total]
            last = [*free, *[total] * k][: k - 1]
            heavy = [r.prefix for r, s in zip(ranges, starts, strict=True) if r.groups > 1 and any(a <= s + r.size and s <= b for a, b in zip(first, last, strict=True))]
            if not heavy:
                cuts = _cuts(ends, high, k) or []
                return high, [ranges[i].prefix for i in cuts if i < len(ranges)]
        gone = set(heavy)
        ranges = [r for r in ranges if r.prefix not in gone] + split(heavy)


def shard(spark: SparkSession, docs: DataFrame, k: int = 8, per_slot_bucket: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("group"))
    rows = common.materialise(spark, rows, "sizes")
    groups = common.materialise(spark, rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")

    def ranges(of: DataFrame, digits: int) -> list[Range]:
        found = of.groupBy(F.substring("group", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("size").alias("largest"))
        return [Range(r["prefix"], r["size"], r["groups"], r["largest"]) for r in found.collect()]

    def split(prefixes: list[str]) -> list[Range]:
        out = []
        for digits in sorted({len(p) for p in prefixes}):
            some = [p for p in prefixes if len(p) == digits]
            out += ranges(groups.where(F.substring("group", 1, digits).isin(some)), digits + MORE_DIGITS)
        return out

    _, begins = plan(ranges(groups, FIRST_DIGITS), k, split)
    of = F.lit(0)
    for p in begins:
        of = of + (F.col("group") >= p).cast("int")
    placed = rows.withColumn("shard", of)

    # slots: rows in earlier buckets of the shard, then the place in the own bucket
    n_buckets = common.buckets_for(rows.count() // k + 1, per_slot_bucket)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "group"), F.lit(n_buckets)))
    before = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "group")) - 1
    numbered = placed.withColumn("place", place).join(before, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
