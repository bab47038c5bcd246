"""Fixed-size bitmaps over 64-bit hashes: a bounded broadcast in front of an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_BITS = 24


def bitmap(hashes: DataFrame, column: str = "h", log_bits: int = LOG_BITS) -> np.ndarray:
    """A bit for the low log_bits bits of each hash: 2 MB at 24, whatever the number of hashes."""
    at = F.col(column).bitwiseAND(F.lit((1 << log_bits) - 1))
    words = (
        hashes.select((F.shiftrightunsigned(at, 6)).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (log_bits - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes the bitmap may hold."""
    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
