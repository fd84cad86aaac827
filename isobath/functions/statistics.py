"""Weighted statistics of groups: aggregates, exact quantiles and gradients.

Aggregates combine on the map side.  Quantiles are exact, and no task holds a group: its rows are dealt by the
leading digits of their values, ``STEPS`` shares an octave, so that shares are in order; each is
sorted for itself, and the weights of the shares before it, a few numbers a group, give its place.  One
exchange serves the sorting and the weights, whatever the number of probabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Shares into which an octave of values is dealt.
STEPS = 64


def share_of(value: Column) -> Column:
    """Number of the share that a finite value lies in: never falls as values rise."""
    size = F.floor(F.log2(F.abs(value)) * STEPS).cast("int") + 100_000  # logarithms of doubles lie within 1,100
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0)


def dealt(rows: DataFrame, by: list[str], value: str, weight: Column, ties: list[str] = []) -> DataFrame:
    """``by, v, w`` of every row, ``upto``, the weights of its group up to it in order of value and ``ties``, and ``every``, all of them."""
    used = rows.select(*by, *ties, F.col(value).alias("v"), weight.alias("w"), share_of(F.col(value)).alias("share"))
    used = used.repartition(*by, "share")
    order = Window.partitionBy(*by, "share").orderBy("v", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = used.select(*by, "share", "v", "w", F.sum("w").over(order).alias("upto"))
    group = Window.partitionBy(*by)
    before = F.sum("n").over(group.orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    shares = used.groupBy(*by, "share").agg(F.sum("w").alias("n"))
    shares = shares.select(*by, "share", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(group).alias("every"))
    return placed.join(shares, [*by, "share"]).select(*by, "v", "w", (F.col("before") + F.col("upto")).alias("upto"), "every")


def weight_of(value: Column, weight: Column) -> Column:
    """The weight where the value is there."""
    return F.when(value.isNotNull(), weight)


def weighted_mean(value: Column, weight: Column) -> Column:
    total = F.sum(weight_of(value, weight))
    return F.when(total > 0, F.sum(value * weight) / total)


def percent_area(value: Column, weight: Column, condition: Column) -> Column:
    """Share of the valid weight where the condition holds, in percent."""
    total = F.sum(weight_of(value, weight))
    return F.when(total > 0, 100.0 * F.sum(F.when(condition, weight_of(value, weight)).otherwise(0.0)) / total)


def coverage(value: Column, weight: Column) -> Column:
    """Share of the weight that has a value."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(F.coalesce(weight_of(value, weight), F.lit(0.0))) / total)


def weighted_deviation(value: Column, weight: Column, mean: Column) -> Column:
    """Population standard deviation about a mean that is known already."""
    total = F.sum(weight_of(value, weight))
    return F.when(total > 0, F.sqrt(F.sum(weight * (value - mean) * (value - mean)) / total))


def weighted_quantiles(rows: DataFrame, by: list[str], value: str, weight: str, probabilities: dict[str, float], ties: list[str] = ["row", "col"]) -> DataFrame:
    """Per group of ``by``, quantiles at the midpoints of the cumulated weight, interpolated linearly.

    Rows without a value or a positive weight don't count; outside the first and last midpoint the
    end values hold.  Equal values are taken in the order of ``ties``, for their weights may differ.
    """
    used = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    placed = dealt(used, by, value, F.col(weight), ties).select(*by, "v", ((F.col("upto") - F.col("w") / 2) / F.col("every")).alias("p"))

    def at(q: float) -> Column:
        low, high = F.max(F.when(F.col("p") <= q, F.col("v"))), F.min(F.when(F.col("p") > q, F.col("v")))
        low_p, high_p = F.max(F.when(F.col("p") <= q, F.col("p"))), F.min(F.when(F.col("p") > q, F.col("p")))
        return F.when(low.isNull(), high).when(high.isNull(), low).otherwise(low + (high - low) * (q - low_p) / (high_p - low_p))

    return placed.groupBy(*by).agg(*[at(q).alias(name) for name, q in probabilities.items()])


def percentiles(rows: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Per group of ``by``, linear quantiles of the values that are there, by their places from 0."""
    placed = dealt(rows.where(F.col(value).isNotNull()), by, value, F.lit(1).cast("long")).withColumn("place", F.col("upto") - 1)

    def at(q: float) -> Column:
        exact = (F.col("every") - 1) * q
        low, high = (F.max(F.when(F.col("place") == f(exact), F.col("v"))) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(exact - F.floor(exact))

    return placed.groupBy(*by).agg(*[at(q).alias(name) for name, q in probabilities.items()])


def gradient(value: Column, coordinate: Column, weight: Column, value_mean: Column, coordinate_mean: Column) -> Column:
    """Weighted least-squares slope about known means; null below two points or two coordinates."""
    w = weight_of(value, weight)
    spread = F.sum(w * (coordinate - coordinate_mean) * (coordinate - coordinate_mean))
    slope = F.sum(w * (coordinate - coordinate_mean) * (value - value_mean)) / spread
    distinct = F.min(F.when(value.isNotNull(), coordinate)) < F.max(F.when(value.isNotNull(), coordinate))
    return F.when(distinct & (F.count(value) >= 2) & (spread > 0), slope)


def circular_mean_degrees(angle: Column, weight: Column) -> Column:
    """Weighted mean direction in degrees, (-180, 180]."""
    return F.degrees(F.atan2(F.sum(weight * F.sin(F.radians(angle))), F.sum(weight * F.cos(F.radians(angle)))))
