"""Area-weighted daily statistics, anomalies and the daily metrics table of gridded cells.

A frame of cells has ``date, row, col, lat, lon, value``; a climatology ``doy, row, col`` and its
statistics.  Cells are joined on integers, never on coordinates.  Each daily statistic is one
aggregation by date, combined on the map side; cell-wise lags are windows per cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.functions import statistics as S


def weighted(cells: DataFrame) -> DataFrame:
    return cells.withColumn("w", C.latitude_weight(F.col("lat")))


def area_means(cells: DataFrame, value: str = "value") -> DataFrame:
    """Mean, coverage and count per date."""
    v, w = F.col(value), F.col("w")
    return weighted(cells).groupBy("date").agg(S.weighted_mean(v, w).alias("mean"), (100.0 * S.coverage(v, w)).alias("coverage_percent"), F.count(v).alias("n_valid"))


def threshold_areas(cells: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    """Cell fraction and area percentages above, and at or above, the threshold per date."""
    v, w = F.col(value), F.col("w")
    return weighted(cells).groupBy("date").agg(
        (F.count_if(v > threshold) / F.nullif(F.count(v), F.lit(0))).alias("fraction_above"),
        S.percent_area(v, w, v > threshold).alias("percent_above"),
        S.percent_area(v, w, v >= threshold).alias("percent_at_or_above"),
    )


def warm_centroid(cells: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    """Centroid per date of the cells at or above the threshold, weighted by value and area."""
    pull = F.when(F.col(value) >= threshold, F.col(value) * F.col("w"))
    total = F.sum(pull)
    return weighted(cells).groupBy("date").agg(*[F.when(total > 0, F.sum(pull * F.col(c)) / total).alias(f"warm_centroid_{c}") for c in ("lat", "lon")])


def persistence(cells: DataFrame, analysis_date: str, window: int, threshold: float, value: str = "value") -> DataFrame:
    """Per cell, the percentage of valid days at or above the threshold in the last ``window`` available dates."""
    if window not in (7, 15, 30):
        raise ValueError("the window is 7, 15 or 30 days")
    until = cells.where(F.col("date") <= F.lit(analysis_date).cast("date"))
    # the dates are few: one row each, the latest first
    last = until.select("date").distinct().orderBy(F.desc("date")).limit(window)
    warm, valid = F.count_if(F.col(value) >= threshold), F.count(value)
    return until.join(F.broadcast(last), "date", "left_semi").groupBy("row", "col").agg((100.0 * warm / F.nullif(valid, F.lit(0))).alias("persistence_percent"))


def profiles(cells: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Latitude profile (plain mean over longitudes) and longitude profile (area-weighted)."""
    rows = weighted(cells)
    by_lat = rows.groupBy("date", "row", "lat").agg(F.avg(value).alias("latitude_profile"))
    by_lon = rows.groupBy("date", "col", "lon").agg(S.weighted_mean(F.col(value), F.col("w")).alias("longitude_profile"))
    return by_lat, by_lon


def matched(cells: DataFrame, climatology: DataFrame, method: str = "daily") -> DataFrame:
    """Cells with their climatological columns, by stable day (``daily``) or month (``monthly``)."""
    key = {"daily": ("doy", C.stable_day(F.col("date"))), "monthly": ("month", F.month("date"))}[method]
    return cells.withColumn(key[0], key[1].cast("int")).join(climatology.drop("lat", "lon"), [key[0], "row", "col"], "left")


def anomalies(cells: DataFrame, climatology: DataFrame, method: str = "daily") -> DataFrame:
    """Cells with ``anomaly`` and ``zscore``; no score where the deviation is zero or missing."""
    rows = matched(cells, climatology, method)
    rows = rows.withColumn("anomaly", F.col("value") - F.col("clim_mean"))
    return rows.withColumn("zscore", F.when(F.col("clim_std") > 0, F.col("anomaly") / F.col("clim_std")))


def time_mean_anomalies(cells: DataFrame) -> DataFrame:
    """Anomaly from each cell's own mean."""
    return cells.withColumn("anomaly", F.col("value") - F.avg("value").over(Window.partitionBy("row", "col")))


def metrics_table(cells: DataFrame, climatology: DataFrame | None, *, method: str = "daily", reference_period: str | None = None, fallback: bool = False) -> DataFrame:
    """The 21 daily metrics of a region, one row per date.

    Rolling means run over seven rows of dates, and changes over one and seven of them, available
    dates rather than calendar days.
    """
    per_cell = Window.partitionBy("row", "col").orderBy("date")
    v, w = F.col("value"), F.col("w")
    rows = weighted(cells).withColumn("change_1", v - F.lag("value", 1).over(per_cell)).withColumn("change_7", v - F.lag("value", 7).over(per_cell))
    wanted = [
        S.weighted_mean(v, w).alias("mean_sst_c"),
        S.weighted_mean(F.col("change_1"), w).alias("mean_daily_sst_change_c"),
        S.weighted_mean(F.col("change_7"), w).alias("seven_day_sst_change_c"),
        (100.0 * S.coverage(v, w)).alias("valid_data_coverage_percent"),
    ]
    if climatology is not None:
        rows = anomalies(rows, climatology, method)
        a, z = F.col("anomaly"), F.col("zscore")
        pull = F.when(a >= 2.0, a * w)
        p90 = F.col("clim_p90") if "clim_p90" in climatology.columns else F.lit(None).cast("double")
        both = F.when(v.isNotNull() & p90.isNotNull(), F.when(v > p90, 1.0).otherwise(0.0))
        wanted += [
            S.weighted_mean(a, w).alias("mean_sst_anomaly_c"),
            S.weighted_mean(z, w).alias("mean_standardized_anomaly"),
            F.max(a).alias("maximum_anomaly_c"),
            *[S.percent_area(a, w, a >= float(t)).alias(f"area_anomaly_ge_{t}c_percent") for t in (1, 2, 3)],
            S.percent_area(z, w, z >= 2.0).alias("area_zscore_ge_2_percent"),
            (100.0 * S.weighted_mean(both, w)).alias("area_above_climatological_p90_percent"),
            *[F.when(F.sum(pull) > 0, F.sum(pull * F.col(c)) / F.sum(pull)).alias(f"warm_centroid_{n}") for c, n in (("lat", "latitude"), ("lon", "longitude"))],
        ]
    daily = rows.groupBy("date").agg(*wanted)
    if climatology is not None:
        daily = daily.join(S.weighted_quantiles(rows, ["date"], "anomaly", "w", {"p90_anomaly_c": 0.9}), "date", "left")
    # one row per date: a single short partition in order of time
    rolling = Window.orderBy("date").rowsBetween(-6, 0)
    missing = [c for c in METRICS[1:-3] if c not in daily.columns and not c.startswith("seven_day_mean")]
    daily = daily.select("*", *[F.lit(None).cast("double").alias(c) for c in missing])
    daily = daily.withColumn("seven_day_mean_sst_c", F.avg("mean_sst_c").over(rolling)).withColumn("seven_day_mean_anomaly_c", F.avg("mean_sst_anomaly_c").over(rolling))
    notes = F.lit(method if climatology is not None else None).cast("string"), F.lit(reference_period).cast("string"), F.lit(fallback)
    for name, value in zip(METRICS[-3:], notes, strict=True):
        daily = daily.withColumn(name, value)
    return daily.select(*METRICS)


#: Columns of the metrics table, a fixed contract.
METRICS = (
    "date", "mean_sst_c", "seven_day_mean_sst_c", "mean_sst_anomaly_c", "mean_standardized_anomaly", "seven_day_mean_anomaly_c",
    "maximum_anomaly_c", "p90_anomaly_c", "mean_daily_sst_change_c", "seven_day_sst_change_c", "area_anomaly_ge_1c_percent",
    "area_anomaly_ge_2c_percent", "area_anomaly_ge_3c_percent", "area_above_climatological_p90_percent", "area_zscore_ge_2_percent",
    "valid_data_coverage_percent", "warm_centroid_longitude", "warm_centroid_latitude", "climatology_method",
    "climatology_reference_period", "climatology_fallback_used",
)


def diagnose(cells: DataFrame, climatology: DataFrame, analysis_date: str, *, threshold: float = 2.0) -> DataFrame:
    """One row for one date: means, extremes, areas and the state against the 90th percentile."""
    day = F.lit(analysis_date).cast("date")
    rows = weighted(anomalies(cells.where(F.col("date") == day), climatology))
    v, a, w = F.col("value"), F.col("anomaly"), F.col("w")
    out = rows.groupBy("date").agg(
        S.weighted_mean(v, w).alias("mean_value"), S.weighted_mean(a, w).alias("mean_anomaly"), F.max(a).alias("maximum_anomaly"),
        S.percent_area(a, w, a >= threshold).alias("area_at_or_above"), S.percent_area(v, w, v > F.col("clim_p90")).alias("area_above_p90"),
        (100.0 * S.coverage(v, w)).alias("coverage_percent"),
    )
    state = F.when(F.col("area_above_p90") >= 50, "widespread").when(F.col("area_above_p90") > 0, "localized").otherwise("not_above")
    return out.withColumn("percentile_state", state).withColumn("flag", C.thermal_flag(F.col("mean_anomaly"), threshold))


def full_diagnosis(cells: DataFrame, climatology: DataFrame | None = None, analysis_date: str | None = None, *, method: str = "daily", threshold: float = 2.0) -> DataFrame:
    """One row of twelve metrics for one date, the last one by default; without a climatology only what needs none.

    Changes are to the date before and the seventh before it among the available dates.
    """
    dates = cells.select("date").distinct()
    if analysis_date is not None:
        dates = dates.where(F.col("date") <= F.lit(analysis_date).cast("date"))
    last = [r["date"] for r in dates.orderBy(F.col("date").desc()).limit(8).collect()]
    if not last or analysis_date is not None and str(last[0]) != analysis_date:
        raise ValueError(f"no cells of {analysis_date or 'any date'}")
    on = lambda k: F.max(F.when(F.col("date") == F.lit(last[k]), F.col("value"))) if len(last) > k else F.lit(None).cast("double")
    rows = cells.where(F.col("date").isin(*{last[k] for k in (0, 1, 7) if len(last) > k})).groupBy("row", "col", "lat", "lon").agg(on(0).alias("value"), on(1).alias("day_before"), on(7).alias("week_before"), F.max(F.col("date") == F.lit(last[0])).alias("there"))
    rows = weighted(rows.where("there").drop("there").withColumn("date", F.lit(last[0])))
    v, w = F.col("value"), F.col("w")
    wanted = {
        "mean_sst_c": S.weighted_mean(v, w), "mean_daily_change_c": S.weighted_mean(v - F.col("day_before"), w), "seven_day_change_c": S.weighted_mean(v - F.col("week_before"), w), "valid_data_coverage_percent": 100.0 * S.coverage(v, w),
    }
    later = ("mean_sst_anomaly_c", "maximum_anomaly_c", "p90_anomaly_c", "area_anomaly_ge_threshold_percent", "warm_centroid_longitude", "warm_centroid_latitude", "area_above_climatological_p90_percent", "percentile_warm_state")
    if climatology is None:
        out = rows.groupBy("date").agg(*[c.alias(n) for n, c in wanted.items()])
        return out.select("*", *[F.lit(None).cast("string" if n == "percentile_warm_state" else "double").alias(n) for n in later])
    rows = anomalies(rows, climatology, method)
    a = F.col("anomaly")
    pull = F.when(a >= threshold, a * w)
    p90 = F.col("clim_p90") if "clim_p90" in climatology.columns else F.lit(None).cast("double")
    both = F.when(v.isNotNull() & p90.isNotNull(), F.when(v > p90, 1.0).otherwise(0.0))
    wanted |= {
        "mean_sst_anomaly_c": S.weighted_mean(a, w), "maximum_anomaly_c": F.max(a), "area_anomaly_ge_threshold_percent": S.percent_area(a, w, a >= threshold), "area_above_climatological_p90_percent": 100.0 * S.weighted_mean(both, w),
        **{f"warm_centroid_{n}": F.when(F.sum(pull) > 0, F.sum(pull * F.col(c)) / F.sum(pull)) for c, n in (("lat", "latitude"), ("lon", "longitude"))},
    }
    out = rows.groupBy("date").agg(*[c.alias(n) for n, c in wanted.items()])
    out = out.join(S.weighted_quantiles(rows, ["date"], "anomaly", "w", {"p90_anomaly_c": 0.9}), "date", "left")
    share = F.col("area_above_climatological_p90_percent")
    return out.withColumn("percentile_warm_state", F.when(share >= 50, "widespread_above_p90").when(share > 0, "localized_above_p90").when(share.isNotNull(), "not_above_p90"))


def latest_diagnosis(cells: DataFrame, *, threshold: float = 2.0) -> DataFrame:
    """``full_diagnosis`` of the last date against the cells' own monthly statistics."""
    from isobath.operators.climatology import monthly

    return full_diagnosis(cells, monthly(cells), method="monthly", threshold=threshold)
