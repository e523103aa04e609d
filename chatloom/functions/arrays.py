"""Array numerics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share_within(a: Column, b: Column, tolerance: float) -> Column:
    """Share of positions that differ by less than ``tolerance``; 0 for unequal or zero lengths."""
    near = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) < tolerance, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), near / F.size(a)).otherwise(0.0)


def is_duplicate(a: Column, b: Column, tolerance: float = 10.0, least: float = 0.98) -> Column:
    return share_within(a, b, tolerance) > least


def without_adjacent_duplicates(rows: DataFrame, group: list[str], order: str, value: str, tolerance: float = 10.0, least: float = 0.98) -> DataFrame:
    """Rows whose array isn't a duplicate of the row's just before it, kept or not."""
    before = F.lag(value).over(W.partitionBy(*group).orderBy(order))
    return rows.withColumn("_before", before).filter(F.col("_before").isNull() | ~is_duplicate(F.col("_before"), F.col(value), tolerance, least)).drop("_before")


def overlap(a: Column, b: Column, row: int, step: int = 20, tolerance: float = 15.0, least: float = 0.85, most: float = 0.8) -> Column:
    """Rows at the end of ``a`` that the start of ``b`` repeats: the largest candidate whose share is high enough, else 0."""
    rows = F.least(F.size(a), F.size(b)) / row
    highest = F.floor(rows * most).cast("int")
    sizes = F.filter(F.transform(F.sequence(F.lit(0), F.floor(highest / step).cast("int")), lambda k: highest - k * step), lambda o: o > 0)
    fits = F.filter(sizes, lambda o: share_within(F.slice(a, (F.size(a) - o * row + 1).cast("int"), (o * row).cast("int")), F.slice(b, 1, (o * row).cast("int")), tolerance) > least)
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(0))


def p75(values: Column, default: float) -> Column:
    """The element at floor(0.75 n) of the sorted values, or the default if there is none or it is 0."""
    v = F.get(F.array_sort(values), F.floor(F.size(values) * 0.75).cast("int"))
    return F.when(F.coalesce(v, F.lit(0)) != 0, v).otherwise(F.lit(default))


def smoothed(values: Column, reach: int) -> Column:
    """Triangular smoothing, weights 1 - |j| / (reach + 1), renormalised at the ends."""

    def at(_: Column, i: Column) -> Column:
        offsets = F.filter(F.sequence(F.lit(-reach), F.lit(reach)), lambda j: (i + j >= 0) & (i + j < F.size(values)))
        weight = lambda j: 1 - F.abs(j) / F.lit(reach + 1.0)
        top = F.aggregate(offsets, F.lit(0.0), lambda s, j: s + weight(j) * F.get(values, i + j))
        return top / F.aggregate(offsets, F.lit(0.0), lambda s, j: s + weight(j))

    return F.transform(values, at)


def longest_run(values: Column, threshold: float) -> Column:
    """Length of the longest stretch of values above the threshold."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, v: Column) -> Column:
        now = F.when(v > threshold, s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(values, start, step, lambda s: s["best"])
