"""Queries of daily statistics, climatologies, the series bank and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.operators import bank, climatology, daily, events
from isobath.plans.common import CLIMATOLOGY, STABLE_DAY, WEIGHTED, quantile_sql, report, rounded
from isobath.sources.driver_tables import FULL_SQL, SERIES_SQL, daily_series, full_grid, grid_cells, grid_sql

GRID = grid_sql()
BASE = f"WITH {GRID}, {WEIGHTED}"


def monthly_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series against its monthly climatology, with a mean over seven days of data."""
    series = daily_series(spark, sf_dir)
    clim = climatology.monthly(series, []).drop("n")
    rows = series.withColumn("month", F.month("date")).join(F.broadcast(clim), "month")  # 12 rows
    anomaly = F.col("value") - F.col("clim_mean")
    rows = rows.select("date", "value", anomaly.alias("anomaly"), F.when(F.col("clim_std") > 0, anomaly / F.col("clim_std")).alias("zscore"))
    from pyspark.sql import Window

    return report(rows.withColumn("seven_day_mean", F.avg("anomaly").over(Window.orderBy("date").rowsBetween(-6, 0))))


MONTHLY_ANOMALY = rounded(
    f"""WITH {SERIES_SQL}, m AS (SELECT month(date) AS month, avg(value) AS clim_mean, stddev_pop(value) AS clim_std FROM series GROUP BY 1),
a AS (SELECT date, value, value - clim_mean AS anomaly, CASE WHEN clim_std > 0 THEN (value - clim_mean) / clim_std END AS zscore FROM series JOIN m ON m.month = month(date))
SELECT *, avg(anomaly) OVER (ORDER BY date ROWS 6 PRECEDING) AS seven_day_mean FROM a""",
    "value, anomaly, zscore, seven_day_mean",
    "date",
)


def area_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(daily.area_means(full_grid(grid_cells(spark, sf_dir, 20, 20))))


AREA_MEANS = rounded(
    f"WITH {grid_sql(20, 20)}, {FULL_SQL}, w AS (SELECT *, cos(radians(lat)) AS w FROM full_cells) SELECT date, sum(value * w) / sum(CASE WHEN value IS NOT NULL THEN w END) AS mean, 100.0 * sum(CASE WHEN value IS NOT NULL THEN w ELSE 0 END) / sum(w) AS coverage_percent, count(value) AS n_valid FROM w GROUP BY date",
    "mean, coverage_percent",
    "date, n_valid",
)


def threshold_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(daily.threshold_areas(grid_cells(spark, sf_dir), 27.0))


THRESHOLD_AREAS = rounded(
    f"{BASE} SELECT date, count(*) FILTER (value > 27) / count(value) AS fraction_above, 100.0 * sum(CASE WHEN value > 27 THEN w ELSE 0 END) / sum(w) AS percent_above, 100.0 * sum(CASE WHEN value >= 27 THEN w ELSE 0 END) / sum(w) AS percent_at_or_above FROM weighted GROUP BY date",
    "fraction_above, percent_above, percent_at_or_above",
    "date",
)


def warm_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(daily.warm_centroid(grid_cells(spark, sf_dir), 27.0))


WARM_CENTROID = rounded(
    f"{BASE} SELECT date, sum(value * w * lat) FILTER (value >= 27) / sum(value * w) FILTER (value >= 27) AS warm_centroid_lat, sum(value * w * lon) FILTER (value >= 27) / sum(value * w) FILTER (value >= 27) AS warm_centroid_lon FROM weighted GROUP BY date",
    "warm_centroid_lat, warm_centroid_lon",
    "date",
)


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(daily.persistence(grid_cells(spark, sf_dir), "2000-05-15", 15, 26.0))


PERSISTENCE = rounded(
    f"WITH {GRID}, d AS (SELECT DISTINCT date FROM cells WHERE date <= DATE '2000-05-15' ORDER BY date DESC LIMIT 15) SELECT row, col, 100.0 * count(*) FILTER (value >= 26) / count(value) AS persistence_percent FROM cells JOIN d USING (date) GROUP BY ALL",
    "persistence_percent",
    "CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col",
)


def latitude_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(daily.profiles(grid_cells(spark, sf_dir))[0].drop("row"))


LATITUDE_PROFILE = rounded(f"WITH {GRID} SELECT date, lat, avg(value) AS latitude_profile FROM cells GROUP BY ALL", "lat, latitude_profile", "date")


def longitude_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(daily.profiles(grid_cells(spark, sf_dir))[1].drop("col"))


LONGITUDE_PROFILE = rounded(f"{BASE} SELECT date, lon, sum(value * w) / sum(w) AS longitude_profile FROM weighted GROUP BY ALL", "lon, longitude_profile", "date")


def time_mean_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(daily.time_mean_anomalies(grid_cells(spark, sf_dir)).select("date", "row", "col", "anomaly"))


_CELL = "CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col"
TIME_MEAN_ANOMALY = rounded(f"WITH {GRID} SELECT date, row, col, value - avg(value) OVER (PARTITION BY row, col) AS anomaly FROM cells", "anomaly", f"date, {_CELL}")


def climatology_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """366 stable days of every cell of a coarse grid."""
    return report(climatology.daily_statistics(grid_cells(spark, sf_dir, 6, 6)))


_CLIM = "n, CAST(doy AS BIGINT) AS doy, " + _CELL
CLIMATOLOGY_DAILY = rounded(f"WITH {grid_sql(6, 6)}, {CLIMATOLOGY} SELECT * FROM clim", "clim_mean, clim_std, clim_median, clim_p10, clim_p90", _CLIM)


def climatology_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """366 stable days of one regional series of several years, leap days among them."""
    return report(climatology.daily_statistics(daily_series(spark, sf_dir), []))


CLIMATOLOGY_SERIES = rounded(
    f"WITH {SERIES_SQL}, cells AS (SELECT date, 0 AS row, 0 AS col, value FROM series), {CLIMATOLOGY} SELECT * FROM clim",
    "clim_mean, clim_std, clim_median, clim_p10, clim_p90",
    "n, CAST(doy AS BIGINT) AS doy",
)


def climatology_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(climatology.monthly(grid_cells(spark, sf_dir)))


CLIMATOLOGY_MONTHLY = rounded(f"WITH {GRID} SELECT month(date) AS month, row, col, avg(value) AS clim_mean, stddev_pop(value) AS clim_std, count(value) AS n FROM cells GROUP BY ALL", "clim_mean, clim_std", f"month, n, {_CELL}")


def climatology_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly statistics out of yearly partial sums."""
    return report(climatology.merged_partials(climatology.yearly_partials(daily_series(spark, sf_dir), []), []))


CLIMATOLOGY_MERGED = rounded(f"WITH {SERIES_SQL} SELECT month(date) AS month, avg(value) AS clim_mean, stddev_pop(value) AS clim_std, CAST(count(value) AS BIGINT) AS n FROM series GROUP BY 1", "clim_mean, clim_std", "month, n")


def climatology_raw_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = daily_series(spark, sf_dir).select("date", F.lit(0).alias("row"), F.lit(0).alias("col"), "value")
    return report(climatology.raw_day_means(series).drop("row", "col"))


CLIMATOLOGY_RAW_DAY = rounded(f"WITH {SERIES_SQL} SELECT dayofyear(date) AS doy, avg(value) AS clim_mean FROM series GROUP BY 1", "clim_mean", "doy")


def climatology_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(climatology.day_jumps(climatology.daily_statistics(daily_series(spark, sf_dir), [])))


CLIMATOLOGY_JUMPS = rounded(
    f"WITH {SERIES_SQL}, cells AS (SELECT date, 0 AS row, 0 AS col, value FROM series), {CLIMATOLOGY} SELECT CAST(a.doy AS BIGINT) AS doy, b.clim_mean - a.clim_mean AS jump FROM clim a JOIN clim b ON b.doy = a.doy % 366 + 1",
    "jump",
    "doy",
)


def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(climatology.calendar(spark))


CALENDAR_DAYS = "SELECT dayofyear(d) AS doy, month(d) AS month, day(d) AS day, strftime(d, '%m-%d') AS month_day FROM (SELECT CAST(unnest(range(DATE '2000-01-01', DATE '2001-01-01', INTERVAL 1 DAY)) AS DATE) AS d)"


def cell_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_cells(spark, sf_dir, 6, 6)
    return report(daily.anomalies(cells, climatology.daily_statistics(cells)).select("date", "row", "col", "anomaly", "zscore"))


CELL_ANOMALIES = rounded(
    f"WITH {grid_sql(6, 6)}, {CLIMATOLOGY} SELECT c.date, c.row, c.col, value - clim_mean AS anomaly, CASE WHEN clim_std > 0 THEN (value - clim_mean) / clim_std END AS zscore FROM cells c LEFT JOIN clim m ON m.row = c.row AND m.col = c.col AND m.doy = {STABLE_DAY}",
    "anomaly, zscore",
    f"date, {_CELL}",
)


def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_cells(spark, sf_dir, 6, 6)
    return report(daily.metrics_table(cells, climatology.daily_statistics(cells), reference_period="all"))


_P90 = quantile_sql("az", "date", "anomaly", "w", {"p90_anomaly_c": 0.9})
METRICS_TABLE = rounded(
    f"""WITH {grid_sql(6, 6)}, {CLIMATOLOGY},
lagged AS (SELECT *, cos(radians(lat)) AS w, value - lag(value, 1) OVER k AS c1, value - lag(value, 7) OVER k AS c7 FROM cells WINDOW k AS (PARTITION BY row, col ORDER BY date)),
az AS (SELECT l.*, clim_p90, value - clim_mean AS anomaly, CASE WHEN clim_std > 0 THEN (value - clim_mean) / clim_std END AS z FROM lagged l LEFT JOIN clim m ON m.row = l.row AND m.col = l.col AND m.doy = {STABLE_DAY}),
p90 AS ({_P90}),
d AS (SELECT date, sum(value * w) / sum(w) AS mean_sst_c, sum(c1 * w) / sum(CASE WHEN c1 IS NOT NULL THEN w END) AS mean_daily_sst_change_c, sum(c7 * w) / sum(CASE WHEN c7 IS NOT NULL THEN w END) AS seven_day_sst_change_c,
  100.0 AS valid_data_coverage_percent, sum(anomaly * w) / sum(w) AS mean_sst_anomaly_c, sum(z * w) / sum(CASE WHEN z IS NOT NULL THEN w END) AS mean_standardized_anomaly, max(anomaly) AS maximum_anomaly_c,
  100.0 * sum(CASE WHEN anomaly >= 1 THEN w ELSE 0 END) / sum(w) AS area_anomaly_ge_1c_percent, 100.0 * sum(CASE WHEN anomaly >= 2 THEN w ELSE 0 END) / sum(w) AS area_anomaly_ge_2c_percent,
  100.0 * sum(CASE WHEN anomaly >= 3 THEN w ELSE 0 END) / sum(w) AS area_anomaly_ge_3c_percent, 100.0 * sum(CASE WHEN z >= 2 THEN w ELSE 0 END) / sum(CASE WHEN z IS NOT NULL THEN w END) AS area_zscore_ge_2_percent,
  100.0 * sum(CASE WHEN value > clim_p90 THEN w ELSE 0 END) / sum(w) AS area_above_climatological_p90_percent,
  sum(anomaly * w * lat) FILTER (anomaly >= 2) / sum(anomaly * w) FILTER (anomaly >= 2) AS warm_centroid_latitude, sum(anomaly * w * lon) FILTER (anomaly >= 2) / sum(anomaly * w) FILTER (anomaly >= 2) AS warm_centroid_longitude
  FROM az GROUP BY date)
SELECT d.*, p90_anomaly_c, avg(mean_sst_c) OVER r AS seven_day_mean_sst_c, avg(mean_sst_anomaly_c) OVER r AS seven_day_mean_anomaly_c, 'daily' AS climatology_method, 'all' AS climatology_reference_period, false AS climatology_fallback_used
FROM d JOIN p90 USING (date) WINDOW r AS (ORDER BY d.date ROWS 6 PRECEDING)""",
    ", ".join(m for m in daily.METRICS[1:-3]),
    "date, climatology_method, climatology_reference_period, climatology_fallback_used",
)


def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_cells(spark, sf_dir, 6, 6)
    return report(daily.diagnose(cells, climatology.daily_statistics(cells), "2000-05-10"))


DIAGNOSIS = rounded(
    f"""WITH {grid_sql(6, 6)}, {CLIMATOLOGY}, a AS (SELECT c.date, value, cos(radians(lat)) AS w, value - clim_mean AS anomaly, clim_p90 FROM cells c LEFT JOIN clim m ON m.row = c.row AND m.col = c.col AND m.doy = {STABLE_DAY} WHERE c.date = DATE '2000-05-10'),
o AS (SELECT date, sum(value * w) / sum(w) AS mean_value, sum(anomaly * w) / sum(w) AS mean_anomaly, max(anomaly) AS maximum_anomaly, 100.0 * sum(CASE WHEN anomaly >= 2 THEN w ELSE 0 END) / sum(w) AS area_at_or_above, 100.0 * sum(CASE WHEN value > clim_p90 THEN w ELSE 0 END) / sum(w) AS area_above_p90, 100.0 AS coverage_percent FROM a GROUP BY date)
SELECT *, CASE WHEN area_above_p90 >= 50 THEN 'widespread' WHEN area_above_p90 > 0 THEN 'localized' ELSE 'not_above' END AS percentile_state, CASE WHEN mean_anomaly > 2 THEN 'above_threshold' ELSE 'below_threshold' END AS flag FROM o""",
    "mean_value, mean_anomaly, maximum_anomaly, area_at_or_above, area_above_p90, coverage_percent",
    "date, percentile_state, flag",
)


_TWELVE = "mean_sst_c, mean_daily_change_c, seven_day_change_c, valid_data_coverage_percent, mean_sst_anomaly_c, maximum_anomaly_c, p90_anomaly_c, area_anomaly_ge_threshold_percent, warm_centroid_longitude, warm_centroid_latitude, area_above_climatological_p90_percent"


def _twelve_sql(clim: str, match: str, day: str, p90: str) -> str:
    """The twelve metrics of the date ``day`` against the climatology ``clim`` joined by ``match``."""
    rows = f"""{clim}, dates AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM cells WHERE date <= {day})),
now AS (SELECT c.*, cos(radians(lat)) AS w FROM cells c JOIN dates USING (date) WHERE k = 1), d1 AS (SELECT c.* FROM cells c JOIN dates USING (date) WHERE k = 2), d7 AS (SELECT c.* FROM cells c JOIN dates USING (date) WHERE k = 8),
a AS (SELECT n.*, n.value - d1.value AS c1, n.value - d7.value AS c7, n.value - clim_mean AS anomaly, {p90} AS p90 FROM now n LEFT JOIN d1 ON d1.row = n.row AND d1.col = n.col LEFT JOIN d7 ON d7.row = n.row AND d7.col = n.col LEFT JOIN clim m ON m.row = n.row AND m.col = n.col AND {match}),
q AS ({quantile_sql('a', 'date', 'anomaly', 'w', {'p90_anomaly_c': 0.9})}),
o AS (SELECT date, sum(value * w) / sum(w) AS mean_sst_c, sum(c1 * w) / sum(CASE WHEN c1 IS NOT NULL THEN w END) AS mean_daily_change_c, sum(c7 * w) / sum(CASE WHEN c7 IS NOT NULL THEN w END) AS seven_day_change_c, 100.0 AS valid_data_coverage_percent,
  sum(anomaly * w) / sum(CASE WHEN anomaly IS NOT NULL THEN w END) AS mean_sst_anomaly_c, max(anomaly) AS maximum_anomaly_c, 100 * sum(CASE WHEN anomaly >= 2 THEN w ELSE 0 END) / sum(CASE WHEN anomaly IS NOT NULL THEN w END) AS area_anomaly_ge_threshold_percent,
  sum(CASE WHEN anomaly >= 2 THEN anomaly * w * lon END) / sum(CASE WHEN anomaly >= 2 THEN anomaly * w END) AS warm_centroid_longitude, sum(CASE WHEN anomaly >= 2 THEN anomaly * w * lat END) / sum(CASE WHEN anomaly >= 2 THEN anomaly * w END) AS warm_centroid_latitude,
  100 * sum(CASE WHEN value > p90 THEN w WHEN p90 IS NOT NULL THEN 0 END) / sum(CASE WHEN p90 IS NOT NULL THEN w END) AS area_above_climatological_p90_percent FROM a GROUP BY date)
SELECT o.*, p90_anomaly_c, CASE WHEN area_above_climatological_p90_percent >= 50 THEN 'widespread_above_p90' WHEN area_above_climatological_p90_percent > 0 THEN 'localized_above_p90' WHEN area_above_climatological_p90_percent IS NOT NULL THEN 'not_above_p90' END AS percentile_warm_state FROM o JOIN q USING (date)"""
    return rounded(f"WITH {grid_sql(6, 6)}, {rows}", _TWELVE, "date, percentile_warm_state")


def full_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve metrics of one date against the daily climatology."""
    cells = grid_cells(spark, sf_dir, 6, 6)
    return report(daily.full_diagnosis(cells, climatology.daily_statistics(cells), "2000-04-10"))


FULL_DIAGNOSIS = _twelve_sql(CLIMATOLOGY, f"m.doy = {STABLE_DAY.replace('date', 'n.date').replace('make_n.date', 'make_date')}", "DATE '2000-04-10'", "clim_p90")


def latest_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve metrics of the last date against the cells' monthly statistics, which have no percentile."""
    return report(daily.latest_diagnosis(grid_cells(spark, sf_dir, 6, 6)))


LATEST_DIAGNOSIS = _twelve_sql("clim AS (SELECT row, col, month(date) AS month, avg(value) AS clim_mean FROM cells GROUP BY ALL)", "m.month = month(n.date)", "DATE '9999-12-31'", "CAST(NULL AS DOUBLE)")


def bank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = full_grid(grid_cells(spark, sf_dir, 20, 20))
    return cells.withColumn("variable", F.lit("sst")).unionByName(daily.time_mean_anomalies(cells).drop("value").withColumnRenamed("anomaly", "value").withColumn("variable", F.lit("anomaly")))


def series_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank_ = bank.series_bank(bank_cells(spark, sf_dir), units={"sst": "degrees_Celsius", "anomaly": "degrees_Celsius"}, minimum_coverage=0.6)
    return report(bank_.select("date", "metric", "family", "value", "status", "n_observations", "valid_coverage"))


_FEATURE = {n: f for n, f, _ in bank.FEATURES} | {n: "centroid" for n, _ in bank.CENTROID}
_GATED = "('state', 'heterogeneity', 'gradient', 'centroid')"
_QUANTILES = quantile_sql("b", "variable, date", "value", "w", {"weighted_median": 0.5, "spatial_p10": 0.1, "spatial_p25": 0.25, "spatial_p75": 0.75, "spatial_p90": 0.9})
_MAD = quantile_sql("c", "variable, date", "apart", "w", {"weighted_mad": 0.5})
SERIES_BANK = rounded(
    f"""WITH {grid_sql(20, 20)}, {FULL_SQL},
b AS (SELECT 'sst' AS variable, date, row, col, lat, lon, value, cos(radians(lat)) AS w FROM full_cells UNION ALL SELECT 'anomaly', date, row, col, lat, lon, value - avg(value) OVER (PARTITION BY row, col), cos(radians(lat)) FROM full_cells),
f AS (SELECT variable, date, sum(value * w) / sum(CASE WHEN value IS NOT NULL THEN w END) AS weighted_mean, min(value) AS spatial_minimum, max(value) AS spatial_maximum, count(value) / count(*) AS valid_cell_fraction,
  sum(CASE WHEN value IS NOT NULL THEN w ELSE 0 END) / sum(w) AS weighted_valid_coverage, CAST(count(value) AS DOUBLE) AS valid_observation_count, 1.0 - count(value) / count(*) AS missing_fraction,
  CASE WHEN min(value) = max(value) THEN 1.0 ELSE 0.0 END AS constant_field_flag, sum(lat * w) FILTER (value IS NOT NULL) / sum(w) FILTER (value IS NOT NULL) AS mlat, sum(lon * w) FILTER (value IS NOT NULL) / sum(w) FILTER (value IS NOT NULL) AS mlon,
  sum(w * greatest(value, 0) * lat) FILTER (value >= 2) / nullif(sum(w * greatest(value, 0)) FILTER (value >= 2), 0) AS warm_centroid_latitude, sum(w * greatest(value, 0) * lon) FILTER (value >= 2) / nullif(sum(w * greatest(value, 0)) FILTER (value >= 2), 0) AS warm_centroid_longitude
  FROM b GROUP BY variable, date),
q AS ({_QUANTILES}),
k AS (SELECT f.*, q.* EXCLUDE (variable, date) FROM f JOIN q USING (variable, date)),
c AS (SELECT b.*, weighted_mean AS m, mlat, mlon, abs(value - weighted_median) AS apart FROM b JOIN k USING (variable, date)),
s AS (SELECT variable, date, sqrt(sum(w * (value - m) * (value - m)) / sum(w) FILTER (value IS NOT NULL)) AS weighted_standard_deviation,
  sum(w * (lat - mlat) * (value - m)) / sum(w * (lat - mlat) * (lat - mlat)) FILTER (value IS NOT NULL) AS latitudinal_gradient, sum(w * (lon - mlon) * (value - m)) / sum(w * (lon - mlon) * (lon - mlon)) FILTER (value IS NOT NULL) AS longitudinal_gradient FROM c GROUP BY variable, date),
m AS ({_MAD}),
wide AS (SELECT k.*, weighted_standard_deviation, latitudinal_gradient, longitudinal_gradient, weighted_mad, spatial_p75 - spatial_p25 AS weighted_iqr, spatial_p90 - spatial_p10 AS p90_minus_p10 FROM k JOIN s USING (variable, date) JOIN m USING (variable, date)),
long AS ({' UNION ALL '.join(f"SELECT variable, date, '{n}' AS feature, '{f}' AS family, {n} AS v, weighted_valid_coverage AS valid_coverage, CAST(valid_observation_count AS BIGINT) AS n_observations FROM wide" + (" WHERE variable = 'anomaly'" if f == "centroid" else "") for n, f in _FEATURE.items())})
SELECT date, variable || '.' || feature AS metric, family, CASE WHEN family IN {_GATED} AND valid_coverage < 0.6 THEN NULL ELSE v END AS value, CASE WHEN v IS NULL OR family IN {_GATED} AND valid_coverage < 0.6 THEN 'not_calculated' ELSE 'valid' END AS status, n_observations, valid_coverage FROM long""",
    "value, valid_coverage",
    "date, metric, family, status, n_observations",
)

RULE = events.EventRule(minimum_duration=2, allowed_gap=1, maximum_calendar_gap=1)
BANDS = {"strong": 10.0, "extreme": 20.0}


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = events.prepared(daily_series(spark, sf_dir))
    return events.daily_flags(events.percentile_threshold(series, 70.0), RULE)


def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    # days outside events have no number: as doubles, missing numbers are alike in both engines
    numbers = ("event", "event_day", "event_age_calendar_days")
    return report(_flags(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in numbers}))


_FLAGS = f"""{SERIES_SQL}, s AS (SELECT date, value, (SELECT quantile_cont(value, 0.7) FROM series) AS threshold FROM series),
n AS (SELECT *, row_number() OVER o AS n, date - lag(date) OVER o AS gap, value >= threshold AS exceeds, value - threshold AS intensity FROM s WINDOW o AS (ORDER BY date)),
b AS (SELECT *, coalesce(gap > 1, false) AS jump, sum(CAST(coalesce(gap > 1, false) AS INTEGER)) OVER (ORDER BY date) AS block FROM n),
p AS (SELECT *, max(CASE WHEN exceeds THEN n END) OVER (PARTITION BY block ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
r AS (SELECT *, sum(CAST(exceeds AND (before IS NULL OR n - before - 1 > 1) AS INTEGER)) OVER (PARTITION BY block ORDER BY date) AS run FROM p),
l AS (SELECT *, max(CASE WHEN exceeds THEN n END) OVER (PARTITION BY block, run) AS last_hit FROM r),
i AS (SELECT *, run > 0 AND n <= last_hit AS inside FROM l),
c AS (SELECT *, inside AND sum(CAST(inside AS INTEGER)) OVER (PARTITION BY block, run) >= 2 AS kept FROM i),
f AS (SELECT *, kept AND row_number() OVER (PARTITION BY block, run ORDER BY CAST(kept AS INTEGER) DESC, n) = 1 AS first FROM c),
e AS (SELECT *, CASE WHEN kept THEN CAST(sum(CAST(first AS INTEGER)) OVER (ORDER BY date) AS BIGINT) END AS event FROM f)"""
EVENT_FLAGS = rounded(
    f"""WITH {_FLAGS} SELECT date, value, threshold, exceeds AS exceeds_threshold, kept AND NOT exceeds AS observed_interruption, event, CASE WHEN kept THEN row_number() OVER m END AS event_day,
CASE WHEN kept THEN date - min(date) OVER m + 1 END AS event_age_calendar_days, intensity, 1.0 AS valid_coverage, CASE WHEN jump THEN 'warning' ELSE 'valid' END AS status,
CASE WHEN jump THEN 'Temporal discontinuity: ' || gap || '-day observation gap exceeds maximum 1' END AS reason FROM e WINDOW m AS (PARTITION BY event ORDER BY date)""",
    "value, threshold, intensity, valid_coverage, event, event_day, event_age_calendar_days",
    "date, exceeds_threshold, observed_interruption, status, reason",
)


def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.event_metrics(_flags(spark, sf_dir), BANDS)
    return report(found.withColumn("event_id", events.event_id("Order price", F.col("event"))).drop("event"))


EVENT_METRICS = rounded(
    f"""WITH {_FLAGS}, mem AS (SELECT *, kept AND NOT exceeds AS pause, row_number() OVER m AS o, (intensity - lag(intensity) OVER m) / (date - lag(date) OVER m) AS rate, coalesce(lag(kept AND NOT exceeds) OVER m, false) AS pause_before FROM e WHERE kept WINDOW m AS (PARTITION BY event ORDER BY date)),
sg AS (SELECT *, CASE WHEN rate <> 0 THEN sign(rate) END AS sg FROM mem),
t AS (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY event ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sg_before FROM sg),
pk AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY event ORDER BY intensity DESC, o) = 1),
a AS (SELECT event, min(date) AS start_date, max(date) AS end_date, count(*) AS duration_observed_days, count(*) FILTER (exceeds) AS exceedance_days, count(*) FILTER (pause) AS interruption_days, 1.0 AS mean_valid_coverage, avg(intensity) AS mean_intensity, max(intensity) AS maximum_intensity, min(intensity) AS minimum_intensity, sum(intensity) AS cumulative_intensity, stddev_pop(intensity) AS intensity_standard_deviation, quantile_cont(intensity, 0.9) AS p90_intensity, arg_min(intensity, date) AS fi, arg_max(intensity, date) AS li, greatest(max(rate), 0) AS up, greatest(max(-rate), 0) AS down, count(*) FILTER (sg <> sg_before) AS turns, count(*) FILTER (pause AND NOT pause_before) AS number_of_observed_interruptions FROM t GROUP BY event)
SELECT 'order-price-E' || lpad(CAST(a.event AS VARCHAR), 4, '0') AS event_id, start_date, end_date, pk.date AS peak_date, end_date - start_date + 1 AS duration_calendar_days, duration_observed_days, exceedance_days, interruption_days, mean_valid_coverage, mean_intensity, maximum_intensity, minimum_intensity, cumulative_intensity, intensity_standard_deviation, p90_intensity, pk.value AS peak_value, pk.threshold AS peak_threshold, pk.intensity AS peak_exceedance,
CASE WHEN pk.date > start_date THEN (maximum_intensity - fi) / (pk.date - start_date) END AS onset_rate, CASE WHEN end_date > pk.date THEN (maximum_intensity - li) / (end_date - pk.date) END AS decline_rate, pk.date - start_date AS time_to_peak_days, end_date - pk.date AS time_from_peak_to_end_days,
CASE WHEN duration_observed_days >= 2 THEN up END AS maximum_daily_intensification, CASE WHEN duration_observed_days >= 2 THEN down END AS maximum_daily_relaxation, CASE WHEN duration_observed_days >= 2 THEN turns END AS number_of_turning_points, number_of_observed_interruptions, mean_intensity * (end_date - start_date + 1) AS mean_intensity_times_duration, CASE WHEN maximum_intensity >= 20 THEN 'extreme' WHEN maximum_intensity >= 10 THEN 'strong' ELSE 'moderate' END AS severity_class
FROM a JOIN pk ON pk.event = a.event""",
    "mean_valid_coverage, mean_intensity, maximum_intensity, minimum_intensity, cumulative_intensity, intensity_standard_deviation, p90_intensity, peak_value, peak_threshold, peak_exceedance, onset_rate, decline_rate, maximum_daily_intensification, maximum_daily_relaxation, mean_intensity_times_duration",
    "event_id, start_date, end_date, peak_date, duration_calendar_days, duration_observed_days, exceedance_days, interruption_days, time_to_peak_days, time_from_peak_to_end_days, number_of_turning_points, number_of_observed_interruptions, severity_class",
)


def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(events.event_summary(_flags(spark, sf_dir)))


EVENT_SUMMARY = f"WITH {_FLAGS} SELECT count(*) AS days, count(*) FILTER (NOT jump) AS valid_days, count(*) FILTER (jump) AS warning_days, CAST(0 AS BIGINT) AS not_calculated_days, coalesce(max(event), 0) AS events, count(event) AS event_days, min(date) AS first_date, max(date) AS last_date FROM e"


def threshold_climatological(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_cells(spark, sf_dir, 6, 6)
    clim = climatology.daily_statistics(cells).join(cells.select("row", "lat").distinct(), "row")
    means = daily.area_means(cells).select("date", F.col("mean").alias("value"))
    return report(events.climatological_threshold(means, clim))


THRESHOLD_CLIMATOLOGICAL = rounded(
    f"WITH {grid_sql(6, 6)}, {CLIMATOLOGY}, t AS (SELECT doy, sum(clim_p90 * cos(radians(-10.0 + row))) / sum(cos(radians(-10.0 + row))) AS threshold FROM clim GROUP BY doy), m AS (SELECT date, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS value FROM cells GROUP BY date) SELECT date, value, threshold FROM m LEFT JOIN t ON t.doy = {STABLE_DAY}",
    "value, threshold",
    "date",
)

QUERIES = {
    "monthly_anomaly": (monthly_anomaly, MONTHLY_ANOMALY), "area_means": (area_means, AREA_MEANS), "threshold_areas": (threshold_areas, THRESHOLD_AREAS),
    "warm_centroid": (warm_centroid, WARM_CENTROID), "persistence": (persistence, PERSISTENCE), "latitude_profile": (latitude_profile, LATITUDE_PROFILE),
    "longitude_profile": (longitude_profile, LONGITUDE_PROFILE), "time_mean_anomaly": (time_mean_anomaly, TIME_MEAN_ANOMALY), "climatology_daily": (climatology_daily, CLIMATOLOGY_DAILY),
    "climatology_series": (climatology_series, CLIMATOLOGY_SERIES), "climatology_monthly": (climatology_monthly, CLIMATOLOGY_MONTHLY), "climatology_merged": (climatology_merged, CLIMATOLOGY_MERGED),
    "climatology_raw_day": (climatology_raw_day, CLIMATOLOGY_RAW_DAY), "climatology_jumps": (climatology_jumps, CLIMATOLOGY_JUMPS), "calendar_days": (calendar_days, CALENDAR_DAYS),
    "cell_anomalies": (cell_anomalies, CELL_ANOMALIES), "metrics_table": (metrics_table, METRICS_TABLE), "diagnosis": (diagnosis, DIAGNOSIS), "full_diagnosis": (full_diagnosis, FULL_DIAGNOSIS), "latest_diagnosis": (latest_diagnosis, LATEST_DIAGNOSIS), "series_bank": (series_bank, SERIES_BANK),
    "event_flags": (event_flags, EVENT_FLAGS), "event_metrics": (event_metrics, EVENT_METRICS), "event_summary": (event_summary, EVENT_SUMMARY), "threshold_climatological": (threshold_climatological, THRESHOLD_CLIMATOLOGICAL),
}
