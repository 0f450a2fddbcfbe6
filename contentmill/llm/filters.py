"""Broadcast filters of a fixed size: bitmaps that executors build by pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Address bits; a bitmap has 8 MB, however many keys it holds.
BITS = 26


def key_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each key (long) at its lowest ``BITS`` bits."""
    place = F.expr(f"({column} & {(1 << BITS) - 1}) + 1")
    pages = keys.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bytes"))
    out = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for page, part in pages.collect():
        out[(page - 1) * len(part) : page * len(part)] = np.frombuffer(bytes(part), dtype=np.uint8)
    return out


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (int64) may be among the bitmap's; never false for one that is."""
    place = keys & ((1 << BITS) - 1)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
