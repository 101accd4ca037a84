"""A bounded filter of keys, so that only rows whose key may be in a table are shuffled to it.

The filter is a bitmap of fixed size, built by ``bitmap_construct_agg`` in 4 KB buckets and broadcast.  A row
whose bit is not set has no match; one whose bit is set goes on to an exact join.  The fuller the bitmap,
the more rows go on for nothing; the result does not depend on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.text import unused

#: Bits of a filter: 16 MB, whatever the number of keys.
BITS = 1 << 27
_BUCKET = 1 << 15


def _place(key: Column, bits: int) -> Column:
    return key.bitwiseAND(F.lit(bits - 1))


def bitmaps(keys: Column, table: DataFrame, bits: int = BITS) -> DataFrame:
    """(bucket, bitmap) of the longs ``keys`` of ``table``, at most ``bits`` / 32768 rows of 4 KB."""
    placed = table.select(_place(keys, bits).alias("at"))
    return placed.groupBy(F.shiftright("at", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(_BUCKET - 1))).alias("bitmap"))


def with_membership(df: DataFrame, key: Column, maps: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """``df`` with a boolean ``name``: whether ``key`` may be among the keys of ``maps``; rows are not shuffled for it."""
    bucket, bitmap = unused(df, "of_bucket"), unused(df, "of_bitmap")
    at = _place(key, bits)
    met = df.join(F.broadcast(maps.withColumnsRenamed({"bucket": bucket, "bitmap": bitmap})), F.shiftright(at, 15) == F.col(bucket), "left")
    within = at.bitwiseAND(F.lit(_BUCKET - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(within, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, within.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
    return met.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(bucket, bitmap)


def as_bits(maps: DataFrame, bits: int = BITS) -> np.ndarray:
    """The whole filter as bytes, bit i of byte j for key 8 j + i: a fixed number of bytes, for Python workers."""
    whole = np.zeros(bits // 8, np.uint8)
    for row in maps.collect():
        at = row["bucket"] * (_BUCKET // 8)
        whole[at : at + _BUCKET // 8] = np.frombuffer(bytes(row["bitmap"]), np.uint8)[: len(whole) - at]
    return whole


def among(whole: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``keys`` may be in the filter."""
    at = keys & np.uint64(8 * len(whole) - 1)
    return (whole[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
