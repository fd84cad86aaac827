"""Climatologies by calendar day and month, pooled over years.

The pool of a day is every sample within a circular distance of it.  Samples are exchanged once, by
cell; a cell's samples (one per date, a bounded array) are laid out by day, and pools and smoothing
read neighbouring days of that array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobath.functions import columns as C

CALENDAR = "sequence(date'2000-01-01', date'2000-12-31')"


def calendar(spark) -> DataFrame:
    """The 366 stable days: ``doy``, ``month``, ``day``, ``month_day``."""
    days = spark.sql(f"SELECT explode({CALENDAR}) AS d")
    return days.select(F.dayofyear("d").alias("doy"), F.month("d").alias("month"), F.day("d").alias("day"), F.date_format("d", "MM-dd").alias("month_day"))


def around(days: Column, half: int, day: Column) -> Column:
    """The entries of a 366-day array within ``half`` days of ``day`` (from 0), around the end of the year."""
    return F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda by: F.get(days, F.pmod(day + by, F.lit(C.DAYS))))


def each_day(entry: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(C.DAYS - 1)), entry)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean_of(values: Column) -> Column:
    """Mean of an array without nulls; null if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def sorted_quantile(values: Column, q: float) -> Column:
    """Linear quantile of an array in ascending order."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    below, above = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return below + (above - below) * (at - low)


def pool_statistics(pool: Column, percentiles: bool) -> Column:
    """Struct of count, mean, population deviation and percentiles of a sorted array."""
    quantile = lambda q: sorted_quantile(pool, q) if percentiles else F.lit(None).cast("double")
    spread = lambda mean: F.when(F.size(pool) > 0, F.sqrt(F.aggregate(pool, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(pool)))
    every = lambda mean: F.struct(F.size(pool).cast("long").alias("n"), mean.alias("mean"), spread(mean).alias("clim_std"), quantile(0.1).alias("p10"), quantile(0.5).alias("clim_median"), quantile(0.9).alias("p90"))
    return bound(mean_of(pool), every)


def daily_statistics(cells: DataFrame, keys: list[str] = ["row", "col"], *, half_window: int = 5, smoothing: int = 31, value: str = "value", percentiles: bool = True) -> DataFrame:
    """Per stable day and cell: count, mean, deviation and exact percentiles of the pooled samples.

    Mean, P10 and P90 are then smoothed by a centred circular mean over ``smoothing`` days; days
    without samples are passed over, and have no row.
    """
    if smoothing % 2 == 0 or smoothing < 1:
        raise ValueError("the smoothing window is odd")
    samples = cells.where(F.col(value).isNotNull()).select(*keys, C.stable_day(F.col("date")).alias("day"), F.col(value).cast("double").alias("v"))
    # dealt by cell, so that a cell's days meet without another exchange
    days = (samples.repartition(*keys) if keys else samples).groupBy(*keys, "day").agg(F.collect_list("v").alias("v"))
    held = days.groupBy(*keys).agg(F.collect_list(F.struct("day", "v")).alias("days"))
    none = F.array().cast("array<double>")
    by_day = bound(F.map_from_entries("days"), lambda m: each_day(lambda d: F.coalesce(m[d + 1], none)))
    pool = lambda days, d: F.array_sort(F.flatten(around(days, half_window, d)))
    raw = bound(by_day, lambda days: each_day(lambda d: bound(pool(days, d), lambda p: pool_statistics(p, percentiles))))
    mean = lambda near, c: mean_of(F.filter(F.transform(near, lambda x: x[c]), lambda x: x.isNotNull())).alias(f"clim_{c}")
    smooth = lambda near: F.struct(*[mean(near, c) for c in ("mean", "p10", "p90")])
    both = bound(raw, lambda r: each_day(lambda d: F.struct(F.get(r, d).alias("raw"), bound(around(r, smoothing // 2, d), smooth).alias("smooth"))))
    out = held.select(*keys, F.posexplode(both).alias("at", "e")).where("e.raw.n > 0")
    return out.select(*keys, (F.col("at") + 1).alias("doy"), "e.raw.n", "e.raw.clim_std", "e.raw.clim_median", "e.smooth.clim_mean", "e.smooth.clim_p10", "e.smooth.clim_p90")


def raw_day_means(cells: DataFrame) -> DataFrame:
    """Mean by plain day of the year, February 29 not set apart."""
    return cells.groupBy(F.dayofyear("date").alias("doy"), "row", "col").agg(F.avg("value").alias("clim_mean"))


def monthly(cells: DataFrame, keys: list[str] = ["row", "col"]) -> DataFrame:
    """Mean, population deviation and count by calendar month."""
    return cells.groupBy(F.month("date").alias("month"), *keys).agg(F.avg("value").alias("clim_mean"), F.stddev_pop("value").alias("clim_std"), F.count("value").alias("n"))


def yearly_partials(cells: DataFrame, keys: list[str] = ["row", "col"]) -> DataFrame:
    """Sums that can be added up over years."""
    return cells.groupBy(F.year("date").alias("year"), F.month("date").alias("month"), *keys).agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.count("value").alias("n"))


def merged_partials(partials: DataFrame, keys: list[str] = ["row", "col"]) -> DataFrame:
    """Monthly statistics of yearly partial sums."""
    mean = F.sum("total") / F.sum("n")
    return partials.groupBy("month", *keys).agg(mean.alias("clim_mean"), F.sqrt(F.greatest(F.sum("squares") / F.sum("n") - mean * mean, F.lit(0.0))).alias("clim_std"), F.sum("n").alias("n"))


def violations(clim: DataFrame, keys: list[str] = ["row", "col"]) -> DataFrame:
    """Rules that a daily climatology breaks, and how often: an empty frame if it is sound."""
    rules = {
        "day_out_of_range": ~F.col("doy").between(1, C.DAYS),
        "not_finite": F.col("n").isNotNull() & (F.col("n") > 0) & F.col("clim_mean").isNull(),
        "negative_deviation": F.col("clim_std") < 0,
        "percentiles_out_of_order": F.col("clim_p10") > F.col("clim_p90"),
        "negative_count": F.col("n") < 0,
    }
    broken = clim.select(F.explode(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()])).alias("rule")).where("rule IS NOT NULL").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    short = clim.groupBy(*keys).agg(F.countDistinct("doy").alias("days")).where(F.col("days") != C.DAYS).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("days_missing").alias("rule"), "n")
    return broken.unionByName(short)


def day_jumps(clim: DataFrame) -> DataFrame:
    """Jump of the regional mean from each day to the next, around the end of the year."""
    daily = clim.groupBy("doy").agg(F.avg("clim_mean").alias("m"))
    after = daily.select(C.wrap_day(F.col("doy") - 1).alias("doy"), F.col("m").alias("next"))
    return daily.join(after, "doy").select("doy", (F.col("next") - F.col("m")).alias("jump"))


def select_baseline(daily_ok: bool, monthly_ok: bool, synthetic_ok: bool, *, data_mode: str, allow_monthly_fallback: bool = True) -> dict[str, object]:
    """Which climatology is used: daily, else monthly if allowed, else synthetic for demo data only."""
    if daily_ok:
        return {"method": "daily", "fallback_used": False, "warning": None}
    if monthly_ok and allow_monthly_fallback:
        return {"method": "monthly", "fallback_used": True, "warning": "daily climatology is unavailable; monthly statistics are used"}
    if synthetic_ok:
        if data_mode == "live":
            raise ValueError("synthetic climatology cannot be used with live data")
        return {"method": "synthetic", "fallback_used": True, "warning": "synthetic climatology"}
    return {"method": "none", "fallback_used": False, "warning": "no climatology is available"}


def tiles(rows: int, columns: int, target: int) -> list[tuple[int, int, int, int]]:
    """Index rectangles (row from, to, column from, to; ends exclusive) of at most ``target`` cells that cover the grid once."""
    if min(rows, columns, target) < 1:
        raise ValueError("rows, columns and target are positive")
    best = None
    for across in range(1, columns + 1):
        width = -(-columns // across)
        height = target // width
        if height < 1:
            continue
        down = -(-rows // min(height, rows))
        score = (across * down, abs(width - -(-rows // down)))
        if best is None or score < best[0]:
            best = score, across, down
    _, across, down = best
    cuts = lambda n, k: [n * i // k for i in range(k + 1)]
    return [(a, b, c, d) for a, b in zip(cuts(rows, down), cuts(rows, down)[1:], strict=False) for c, d in zip(cuts(columns, across), cuts(columns, across)[1:], strict=False)]


def build_plan(target_cells: int, source_cells: int, days: int, *, tile_cells: int = 30_000, overhead_bytes: float = 3.5 * 2**30, memory_limit: float = 8 * 2**30, disk_limit: float = 80 * 2**30) -> dict[str, object]:
    """Estimated bytes of a build, and whether the limits allow it."""
    tile = min(tile_cells, target_cells)
    memory = tile * days * 4 * 1.75 + tile * C.DAYS * 32 + overhead_bytes
    disk = source_cells * days * 4 + target_cells * C.DAYS * 32
    fits = memory <= memory_limit and disk <= disk_limit
    return {"tiles": -(-target_cells // tile), "peak_memory_bytes": memory, "disk_bytes": disk, "status": "valid" if fits else "resource_limit_exceeded"}
