"""A Bloom filter of bounded size over 64-bit keys, formed by Spark.

It only saves work: what it wrongly lets pass is met and dropped later, and it never
holds back a key that it was given. So its size is fixed (2^BITS bits), whatever the
number of keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


class Filter:
    def __init__(self, words: np.ndarray):
        self.words = words

    def _has(self, place: np.ndarray) -> np.ndarray:
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0

    def has(self, keys: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << BITS) - 1)
        return self._has(keys & low) & self._has((keys >> np.uint64(32)) & low)


def filter_of(keys: DataFrame, column: str = "key") -> Filter:
    """The filter of a column of longs. The driver sees its words alone, 2^(BITS - 6) at most."""
    key = F.col(column)
    places = F.array(key.bitwiseAND(F.lit((1 << BITS) - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit((1 << BITS) - 1)))
    place = keys.select(F.explode(places).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("word")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[np.asarray(words.column("at").combine_chunks())] = np.asarray(words.column("word").combine_chunks()).view(np.uint64)
    return Filter(out)
