"""Exact percentiles of groups of any size, by rounds of selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import forget, saved

#: Distinct values of a group that one task puts in order, at most; ranges into which a round cuts a larger one.
ORDERED, RANGES = 65_536, 256
#: Rows of ranges that are sent to all executors, at most.
SENT = 20_000


def exact_percentiles(df: DataFrame, value: str, names: dict[str, float], *by: str, ordered: int = ORDERED) -> DataFrame:
    """One row for each group (one in all without ``by``) with exact percentiles, linearly interpolated; null without a value.

    Values are counted first, which spreads a large group over all tasks.  While a group has more than ``ordered`` distinct values
    where a wanted rank may lie, a sketch cuts them into RANGES, counts tell which range each rank lies in, and only those go on:
    a round for each factor of RANGES above ``ordered``.  What is left is put in order.  The counts are a table in the shared folder.
    """
    keys = list(by) or ["_all"]
    groups = [F.col(c) for c in by] or [F.lit(0).alias("_all")]
    base = df.select(*groups, F.col(value).cast("double").alias("_v"))
    counts = saved(base.groupBy(*keys, "_v").agg(F.count("*").alias("_n")), "values")
    has = F.col("_v").isNotNull()
    whole = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(has, F.col("_n"))), F.lit(0)).alias("_total"), F.count("_v").alias("_inside"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    exact = {n: F.lit(f) * (F.col("_total") - 1) for n, f in names.items()}
    wanted = [r for x in exact.values() for r in (F.floor(x), F.ceil(x))]

    def holds(first: Column, last: Column) -> Column:
        return reduce(lambda a, b: a | b, [(r >= first) & (r < last) for r in wanted])

    ranges = saved(whole.select(*keys, "_total", "_inside", "_lo", "_hi", F.lit(0).cast("long").alias("_before")), "ranges")
    while (ranges.agg(F.max("_inside")).first()[0] or 0) > ordered:
        rows = _within(counts, ranges, keys)
        cut = rows.where(F.col("_inside") > ordered)
        marks = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
        sketch = saved(cut.groupBy(*keys, "_lo").agg(F.percentile_approx("_v", marks, F.lit(20 * RANGES)).alias("_marks")), "marks")
        part = F.size(F.filter("_marks", lambda m: m <= F.col("_v")))
        dealt = _joined(cut, _small(sketch), [*keys, "_lo"]).select(*[F.col(f"a.{k}") for k in keys], "_total", F.col("a._lo").alias("_lo"), "_before", "_v", "_n", part.alias("_part"))
        inside = dealt.groupBy(*keys, "_total", "_lo", "_before", "_part").agg(F.sum("_n").alias("_k"), F.count("*").alias("_inside"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        first = F.col("_before") + F.sum("_k").over(Window.partitionBy(*keys, "_lo").orderBy("_part")) - F.col("_k")
        found = inside.withColumn("_first", first).where(holds(F.col("_first"), F.col("_first") + F.col("_k")))
        done = ranges.where(F.col("_inside") <= ordered)
        after = saved(found.select(*keys, "_total", "_inside", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), F.col("_first").alias("_before")).unionByName(done), "ranges")
        forget(ranges)
        forget(sketch)
        ranges = after
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_lo").orderBy("_v"))
    placed = _within(counts, ranges, keys).withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_last")), F.col("_v")))

    out = placed.where(holds(F.col("_first"), F.col("_last"))).groupBy(*keys).agg(*[(at(F.floor(x)) + (at(F.ceil(x)) - at(F.floor(x))) * F.max(x - F.floor(x))).alias(n) for n, x in exact.items()])
    every = ranges.select(*keys).distinct()
    return _joined(every, out, keys, "left").select(*[F.col(f"a.{k}") for k in by], *[F.col(f"b.{n}") for n in names])


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.alias("a").join(b.alias("b"), same, how)


def _small(df: DataFrame) -> DataFrame:
    """df, sent to all executors where it has at most SENT rows: then rows of a large group stay where they are."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def _within(counts: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Values and their counts with the range that they are in; others go."""
    both = _joined(counts, _small(ranges), keys).where("_v between _lo and _hi")
    return both.select(*[F.col(f"a.{k}") for k in keys], "_v", "_n", "_total", "_inside", "_lo", "_before")
