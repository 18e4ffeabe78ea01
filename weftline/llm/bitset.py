"""A bounded membership filter over 64-bit hashes: built by Spark aggregation, probed with numpy.

It never misses a member, so what it lets through only has to be checked by the join that follows. Its size
is bounded (MAX_BITS), whatever the number of members; beyond that it lets more through and the join does more."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MB.
MAX_BITS = 1 << 27


def build(members: DataFrame, column: str, per_member: int = 32) -> np.ndarray:
    """64-bit words of the filter over the long column of hashes; one distributed bit_or, at most MAX_BITS / 64 rows."""
    n = members.count()
    bits = 1 << min(int(math.log2(MAX_BITS)), max(12, math.ceil(math.log2(max(1, n) * per_member))))
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    one = F.expr(f"shiftleft(1L, cast(({column} & {bits - 1}) & 63 as int))")
    rows = members.where(F.col(column).isNotNull()).groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    got = rows.toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def probe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where the hash may be a member."""
    h = h.astype(np.uint64, copy=False)
    slot = h & np.uint64(len(table) * 64 - 1)
    return ((table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
