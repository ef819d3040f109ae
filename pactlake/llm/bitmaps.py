"""Bitmaps of fixed size over 64-bit names: what has no bit is surely not among the names.

Names that share a bit only let more through, so a bitmap saves work and never decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: 8 MB, at any size of the corpus.
BITS = 1 << 26


def bitmap(names: DataFrame, name: str) -> np.ndarray:
    """BITS bits, of which those of the names are set; Spark puts 64 into a row."""
    bit = names.select(F.pmod(name, F.lit(BITS)).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    rows = bit.groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def marked(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether the bit of each name (64-bit) is set."""
    bit = np.mod(names.view(np.int64), BITS)
    return (bits[bit >> 6] >> (bit & 63) & 1).astype(bool)
