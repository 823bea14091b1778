"""A filter of fixed size over 64-bit hashes: rows that cannot join are dropped before
any shuffle. Its size is a parameter and does not grow with the data; where it fills,
more rows pass, and the join that follows still decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24


def build(rows: DataFrame, hashed: Column, bits: int = BITS) -> np.ndarray:
    """The bitmap of a column of longs: at most 2**(bits - 6) words come to the driver."""
    bit = F.pmod(hashed, F.lit(1 << bits))
    words = rows.select(F.shiftright(bit, 6).alias("word"), F.pmod(bit, F.lit(64)).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(found.column("word"), np.int64)] = np.asarray(found.column("mask"), np.int64)
    return out.view(np.uint64)


def passes(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (as uint64) may be in the bitmap."""
    bit = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
