"""Ordered computations over groups that may hold a large share of all rows.

A window over a hot key sorts the whole key in one task. These helpers cut the order axis at approximate quantiles of
the data, work per (key, slice), and carry the totals between slices, which are as few as the cuts. Results are exact
wherever the cuts fall.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slices of an order axis, a power of two. The number does not depend on the cluster: a row finds its slice in eight steps.
SLICES = 256


def cut_points(df: DataFrame, axis: Column, tie: Column | None = None) -> list[tuple]:
    """Sorted cuts (axis value, tie value or None) at approximate quantiles of numeric columns, fewer than ``SLICES``.

    An axis value that takes several quantiles is cut again along ``tie``, so rows that share it are spread too.
    """
    shares = [i / SLICES for i in range(1, SLICES)]
    row = df.agg(F.percentile_approx(axis, shares, 10000).alias("cuts")).first()
    times = Counter(row["cuts"] or [])
    found = [(value, None) for value in times]
    hot = [value for value, n in times.items() if n > 1]
    if tie is not None and hot:
        inside = df.select(axis.alias("a"), tie.alias("t")).where(F.col("a").isin(hot))
        for r in inside.groupBy("a").agg(F.percentile_approx("t", shares, 10000).alias("cuts")).collect():
            cuts, n = r["cuts"] or [], times[r["a"]]
            found += {(r["a"], cuts[len(cuts) * i // n]) for i in range(n) if cuts}
    return sorted(found, key=lambda c: (c[0], c[1] is not None, c[1] or 0))


def slice_of(df: DataFrame, axis: Column, tie: Column | None = None) -> Column:
    """Index of a row's slice: the number of cuts at or below it, found by halving."""
    cuts = cut_points(df, axis, tie)
    if not cuts:
        return F.lit(0)
    place = F.struct(axis.alias("a"), (F.lit(0) if tie is None else tie).alias("t"))
    kind = df.select(place.alias("p")).schema["p"].dataType.simpleString()
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(t).alias("t")) for a, t in cuts]).cast(f"array<{kind}>")
    steps = F.array(*[F.lit(SLICES >> k) for k in range(1, SLICES.bit_length())])
    # A cut without a tie value lies before all rows of its axis value, as null is the smallest.
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= place, at + step).otherwise(at))


def ranked(df: DataFrame, keys: list[str], axis: Column, order: list, name: str, tie: Column | None = None) -> DataFrame:
    """Row number (from 1) per key in the given order; ``axis`` must be the first sort key, ascending, ``tie`` the second."""
    sliced = df.withColumn("_slice", slice_of(df, axis, tie))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    joined = sliced.join(starts, [*keys, "_slice"])
    return joined.withColumn(name, F.col("_start") + F.row_number().over(inside)).drop("_slice", "_start")


def with_previous(df: DataFrame, keys: list[str], axis: Column, order: list, value: str, name: str, tie: Column | None = None) -> DataFrame:
    """Value of the previous row per key, null on the first; ``axis`` must be the first sort key, ascending, ``tie`` the second."""
    sliced = df.withColumn("_slice", slice_of(df, axis, tie))
    sort_key = F.struct(*order)
    last = sliced.groupBy(*keys, "_slice").agg(F.max_by(F.col(value), sort_key).alias("_last"))
    carried = last.select(*keys, "_slice", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carried"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    joined = sliced.join(carried, [*keys, "_slice"])
    return joined.withColumn(name, F.coalesce(F.lag(value).over(inside), F.col("_carried"))).drop("_slice", "_carried")


def element_at_share(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """Per key, the element at index floor(share * n) of the sorted values, exactly."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    sliced = counted.withColumn("_slice", slice_of(df, F.col(value)))
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_n"))
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        totals.withColumn("_end", F.sum("_n").over(upto))
        .withColumn("_all", F.sum("_n").over(per_key))
        .withColumn("_target", F.floor(F.col("_all") * F.lit(share)))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
        .where("_target >= _begin AND _target < _end")
        .select(*keys, "_slice", "_begin", "_target")
    )
    running = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(spans, [*keys, "_slice"])
        .withColumn("_upto", F.col("_begin") + F.sum("_n").over(running))
        .where("_upto > _target")
        .groupBy(*keys)
        .agg(F.min(value).alias(name))
    )
