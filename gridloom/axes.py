"""Positions and as-of look-ups along an axis of any size, without one task that sorts it all.

An axis of at most ``IN_ONE`` labels, which is counted first, is ordered in one task. A longer one is cut
into ranges at labels of a sample drawn by hash (``SAMPLE`` for each range); the ranges are ordered side by
side, and only a row for each range (``RANGES`` at most) meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IN_ONE, RANGES, SAMPLE = 1 << 17, 256, 32


def _bounds(df: DataFrame, key: Column, ranges: int) -> DataFrame:
    """One row: the keys at which ranges begin, in order."""
    drawn = df.select(key.alias("k")).where("k is not null").orderBy(F.xxhash64("k"), "k").limit(ranges * SAMPLE)
    keys = F.sort_array(F.collect_list("k"))
    return drawn.agg(F.filter(keys, lambda _, i: (i % SAMPLE == 0) & (i > 0)).alias("__bounds"))


def _ranged(df: DataFrame, key: Column, bounds: DataFrame) -> DataFrame:
    """Rows with the number of the range of their key (null: the first)."""
    number = F.size(F.filter("__bounds", lambda b: b <= key))
    return df.crossJoin(F.broadcast(bounds)).withColumn("__range", number).drop("__bounds")


def _ranges(n: int, in_one: int) -> int:
    return min(RANGES, -(-n // in_one))


def numbered(df: DataFrame, key: Column | str, name: str = "pos", descending: bool = False, in_one: int | None = None) -> DataFrame:
    """Rows with their place from 0 in the order of ``key`` (a column or struct; nulls first, last if descending)."""
    key, in_one, n = F.col(key) if isinstance(key, str) else key, in_one or IN_ONE, df.count()
    if n <= in_one:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(key.desc() if descending else key)) - 1).cast("long"))
    ranged = _ranged(df, key, _bounds(df, key, _ranges(n, in_one)))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1 + F.col("__before")
    if descending:
        place = n - 1 - place
    return ranged.join(F.broadcast(sizes), "__range").withColumn(name, place.cast("long")).drop("__range", "__before")


def latest(axis: DataFrame, wanted: DataFrame, dim: str, in_one: int | None = None) -> DataFrame:
    """(dim, __at) for each distinct label of ``wanted``: the greatest label of ``axis`` at or below it, or null."""
    both = axis.select(F.col(dim).alias("__l"), F.lit(0).alias("__side")).unionByName(wanted.select(F.col(dim).alias("__l"), F.lit(1).alias("__side")).distinct())
    known = F.when(F.col("__side") == 0, F.col("__l"))
    n, in_one = both.count(), in_one or IN_ONE
    if n <= in_one:
        w = Window.orderBy("__l", "__side").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("__at", F.last(known, ignorenulls=True).over(w))
    else:
        both = _ranged(both, F.col("__l"), _bounds(both, F.col("__l"), _ranges(n, in_one)))
        tops = both.groupBy("__range").agg(F.max(known).alias("__top"))
        before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        tops = tops.select("__range", F.max("__top").over(before).alias("__carried"))
        w = Window.partitionBy("__range").orderBy("__l", "__side").rowsBetween(Window.unboundedPreceding, 0)
        both = both.join(F.broadcast(tops), "__range").withColumn("__at", F.coalesce(F.last(known, ignorenulls=True).over(w), "__carried"))
    return both.where("__side = 1").select(F.col("__l").alias(dim), "__at")
