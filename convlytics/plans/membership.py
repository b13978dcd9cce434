"""Membership tests that leave wide rows where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 8 MB broadcast, whatever the input.
BITS = 1 << 26


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits).cast("bigint"))


def split_by_filter(rows: DataFrame, key: str, members: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key may be in ``members`` (one column ``key``), and those whose key is not.

    The filter is a bitmap of hashed keys.  Its size is fixed, so it is broadcast; with many more
    keys than bits all rows are in the first part, which is then as large as without a filter.
    """
    place = _place(F.col(key), bits)
    marks = members.select(key).groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits")
    )
    met = rows.withColumn("__place", place).join(F.broadcast(marks), F.bitmap_bucket_number("__place") == F.col("__bucket"), "left")
    at = F.bitmap_bit_position("__place")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return met.where(maybe).select(*rows.columns), met.where(~maybe).select(*rows.columns)


def without(rows: DataFrame, key: str, members: DataFrame, bits: int = BITS) -> DataFrame:
    """Anti join: only rows that pass the filter are shuffled to meet ``members``."""
    maybe, never = split_by_filter(rows, key, members, bits)
    return never.unionByName(maybe.join(members.select(key), key, "left_anti"))


def one_of_each(rows: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """One row per key: keys are counted first, and only rows of repeated keys are shuffled."""
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key)
    maybe, never = split_by_filter(rows, key, repeated, bits)
    return never.unionByName(maybe.dropDuplicates([key]))
