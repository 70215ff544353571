"""Neighbours and running sums in the order of a key, without bringing a table into one partition.

The key's range is cut at values of the key itself: of those that a hash chooses every FINER-th, so that buckets are about even
and hold about ``every`` rows, more in very large tables so that the list of cuts stays below about MOST_CUTS numbers (it is part of
the plan).  Rows are then dealt out by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVERY, FINER, MOST_CUTS = 32, 8, 32_768


def cuts(df: DataFrame, key: Column, every: int = EVERY) -> list[int]:
    """Ascending values of an integer key at which buckets begin; the first is the least key.  Null keys are left out."""
    keys = df.select(key.cast("long").alias("key")).where("key is not null")
    rows, least = keys.agg(F.count("*"), F.min("key")).first()
    if not rows:
        return []
    one_in = max(1, every // FINER, rows // (FINER * MOST_CUTS))
    chosen = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0).distinct().collect())
    return sorted({least, *chosen[FINER - 1 :: FINER]})


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Number of the bucket of a key by binary search; keys below the first cut, and nulls, are in bucket 0."""
    if not bounds:
        return F.lit(0)
    steps = F.lit([1 << i for i in reversed(range(len(bounds).bit_length()))])
    places = F.lit(bounds)
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < len(bounds)) & (F.get(places, at + step) <= key), at + step).otherwise(at))
    return found
