"""Bloom filters as bitmap tables, built and read by DataFrame operators.

A filter of ``bits`` cells is a table (page, map) of 4 kB bitmaps.  A key has
its page and ``HASHES`` cells in it, so one join reads them all.  A filter holds
``MOST_BITS`` cells (128 MB) at most: a proven bound, so it is broadcast.  At
60 million keys there are 16 cells a key; beyond, more rows test positive (at
16 times as many nearly all).  Those who use a filter let positives go on to an
exact join, so results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 2
PAGE = 32768  # bits of one bitmap of bitmap_construct_agg
MOST_BITS = 1 << 30


def filter_bits(rows: int) -> int:
    """16 cells a key, as a power of two, within the bound."""
    bits = PAGE
    while bits < 16 * rows and bits < MOST_BITS:
        bits *= 2
    return bits


def page_of(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(max(bits // PAGE, 1)))


def cells(keys: list[Column], bits: int) -> list[Column]:
    """The places of a key's cells in its page."""
    return [F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(min(bits, PAGE))) for i in range(HASHES)]


def bitmaps(rows: DataFrame, keys: list[Column], bits: int, least: int = 1) -> DataFrame:
    """Bitmaps of the cells that ``least`` rows or more set; counts are combined before the shuffle."""
    cell = rows.select(page_of(keys, bits).alias("page"), F.explode(F.array(*cells(keys, bits))).alias("cell")).groupBy("page", "cell")
    some = cell.agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return some.groupBy("page").agg(F.expr("bitmap_construct_agg(cell)").alias("map"))


def probe(rows: DataFrame, maps: DataFrame, keys: list[Column], bits: int, name: str = "maybe") -> DataFrame:
    """``rows`` with the boolean ``name``: false only if the key is certainly not in the filter.

    The columns of ``rows`` must not be named like those made here.
    """
    columns, found = rows.columns, F.col("bloom_map").isNotNull()
    rows = rows.withColumns({"bloom_page": page_of(keys, bits)} | {f"bloom_cell{i}": c for i, c in enumerate(cells(keys, bits))})
    rows = rows.join(F.broadcast(maps.select(F.col("page").alias("bloom_page"), F.col("map").alias("bloom_map"))), "bloom_page", "left")
    for i in range(HASHES):
        byte = F.conv(F.hex(F.expr(f"substring(bloom_map, cast(bloom_cell{i} div 8 + 1 as int), 1)")), 16, 10).cast("int")
        found = found & (F.call_function("shiftright", byte, (F.col(f"bloom_cell{i}") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return rows.select(*columns, F.coalesce(found, F.lit(False)).alias(name))
