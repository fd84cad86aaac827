"""Queries of temporal features, quality control, regions, selections and facts."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.operators import climatology, coast, daily, facts, overview, quality, regional, temporal
from isobath.plans.common import CLIMATOLOGY, STABLE_DAY, report, rounded
from isobath.sources import cells as cell_sources
from isobath.sources.driver_tables import FULL_SQL, SERIES_SQL, daily_series, full_grid, grid_cells, grid_sql

GRID = grid_sql()
DAYS = (7, 30)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of the daily series from its mean, so that signs change."""
    own = daily_series(spark, sf_dir)
    return own.crossJoin(F.broadcast(own.agg(F.avg("value").alias("m")))).select(F.lit("orders.mean").alias("metric"), "date", (F.col("value") - F.col("m")).alias("value"))  # one row


_WIN = f"""{SERIES_SQL}, s AS (SELECT date, value - (SELECT avg(value) FROM series) AS v FROM series),
w AS (SELECT e.date AS "end", d.days, s.date, s.v FROM s e CROSS JOIN (SELECT unnest([7, 30]) AS days) d JOIN s ON s.date BETWEEN e.date - CAST(d.days - 1 AS INTEGER) AND e.date),
p AS (SELECT *, CASE WHEN date - lag(date) OVER o = 1 THEN lag(v) OVER o END AS p, CASE WHEN date - lag(date, 2) OVER o = 2 THEN lag(v, 2) OVER o END AS pp, date - min(date) OVER (PARTITION BY "end", days) AS t, min(v) OVER (PARTITION BY "end", days) AS lo, max(v) OVER (PARTITION BY "end", days) AS hi FROM w WINDOW o AS (PARTITION BY "end", days ORDER BY date)),
r AS (SELECT *, CASE WHEN v > 0 THEN sum(CASE WHEN v > 0 AND NOT coalesce(p > 0, false) THEN 1 ELSE 0 END) OVER o END AS ra, CASE WHEN v < 0 THEN sum(CASE WHEN v < 0 AND NOT coalesce(p < 0, false) THEN 1 ELSE 0 END) OVER o END AS rb FROM p WINDOW o AS (PARTITION BY "end", days ORDER BY date)),
z AS (SELECT *, CASE WHEN ra IS NOT NULL THEN count(*) OVER (PARTITION BY "end", days, ra) END AS sa, CASE WHEN rb IS NOT NULL THEN count(*) OVER (PARTITION BY "end", days, rb) END AS sb FROM r)"""
_SIMPLE = {
    "mean": "avg(v)", "median": "median(v)", "minimum": "min(v)", "maximum": "max(v)", "p10": "quantile_cont(v, 0.1)", "p25": "quantile_cont(v, 0.25)", "p75": "quantile_cont(v, 0.75)", "p90": "quantile_cont(v, 0.9)",
    "mean_absolute_value": "avg(abs(v))", "rms": "sqrt(avg(v * v))", "positive_load": "avg(greatest(v, 0))", "negative_load": "avg(greatest(-v, 0))", "positive_accumulation": "sum(greatest(v, 0))", "negative_accumulation": "sum(greatest(-v, 0))",
    "variance": "var_pop(v)", "standard_deviation": "stddev_pop(v)", "mean_absolute_successive_change": "avg(abs(v - p))", "rmssd": "sqrt(avg((v - p) * (v - p)))", "maximum_absolute_jump": "max(abs(v - p))",
    "sign_change_count": "CASE WHEN count(p) > 0 THEN CAST(count(*) FILTER (sign(v) * sign(p) = -1) AS DOUBLE) END", "turning_point_count": "CASE WHEN count(p) > 0 THEN CAST(count(*) FILTER (p IS NOT NULL AND (v - p) * (p - pp) < 0) AS DOUBLE) END",
    "proportion_changes_over_threshold": "count(*) FILTER (abs(v - p) > 0.5) / nullif(count(p), 0)", "ols_slope": "regr_slope(v, t)", "ols_intercept": "regr_intercept(v, t)", "ols_r_squared": "regr_r2(v, t)", "initial_final_difference": "arg_max(v, date) - arg_min(v, date)",
    "lag1_autocorrelation": "CASE WHEN count(p) >= 2 AND stddev_pop(p) > 0 AND stddev_pop(CASE WHEN p IS NOT NULL THEN v END) > 0 THEN corr(v, p) END", "longest_run_above_threshold": "CAST(coalesce(max(sa), 0) AS DOUBLE)", "mean_run_length_above_threshold": "coalesce(count(ra) / nullif(count(DISTINCT ra), 0), 0)",
    "longest_run_below_threshold": "CAST(coalesce(max(sb), 0) AS DOUBLE)", "proportion_above_threshold": "avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)", "proportion_below_threshold": "avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END)", "state_transition_count": "CAST(count(*) FILTER ((v > 0) <> (p > 0)) AS DOUBLE)",
}
_DERIVED = ("iqr", "p90_minus_p10", "mad", "decorrelation_time", "shannon_entropy")


def temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = temporal.simple_features(temporal.windowed(_series(spark, sf_dir), DAYS))
    return report(wide.where("n >= 5").select("end", "days", "n", *_SIMPLE, *_DERIVED))


TEMPORAL_FEATURES = rounded(
    f"""WITH {_WIN}, a AS (SELECT "end", days, count(*) AS n, {', '.join(f'{v} AS {k}' for k, v in _SIMPLE.items())} FROM z GROUP BY ALL),
m AS (SELECT "end", days, median(abs(v - median)) AS mad FROM z JOIN a USING ("end", days) GROUP BY ALL),
b AS (SELECT "end", days, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 10), 9) ELSE 5 END AS bin, count(*) AS c FROM z GROUP BY ALL),
h AS (SELECT "end", days, -sum(s * log2(s)) AS shannon_entropy FROM (SELECT *, c / sum(c) OVER (PARTITION BY "end", days) AS s FROM b) GROUP BY ALL)
SELECT a.*, p75 - p25 AS iqr, p90 - p10 AS p90_minus_p10, mad, CASE WHEN lag1_autocorrelation > 0 AND lag1_autocorrelation < 1 - 1e-9 THEN -1 / ln(lag1_autocorrelation) END AS decorrelation_time, shannon_entropy FROM a JOIN m USING ("end", days) JOIN h USING ("end", days) WHERE n >= 5""",
    ", ".join([*_SIMPLE, *_DERIVED]),
    '"end", CAST(days AS BIGINT) AS days, n',
)


def trend_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.theil_sen(temporal.windowed(_series(spark, sf_dir), (15,)))
    return report(out.select("end", "theil_sen_slope", "mann_kendall_tau"))


TREND_PAIRS = rounded(
    f"""WITH {SERIES_SQL}, s AS (SELECT date, value - (SELECT avg(value) FROM series) AS v FROM series),
w AS (SELECT e.date AS "end", s.date, s.v FROM s e JOIN s ON s.date BETWEEN e.date - 14 AND e.date),
q AS (SELECT a."end", (b.v - a.v) AS rise, b.date - a.date AS run FROM w a JOIN w b ON a."end" = b."end" AND b.date > a.date)
SELECT "end", median(rise / run) AS theil_sen_slope, sum(sign(rise)) / nullif(sqrt(CAST(count(*) - count(*) FILTER (rise = 0) AS DOUBLE) * count(*)), 0) AS mann_kendall_tau FROM q GROUP BY 1""",
    "theil_sen_slope, mann_kendall_tau",
    '"end"',
)


#: Features that one row of ``wide_features`` has.
_ALL = sorted({n for names in temporal.FAMILIES.values() for n in names} - {"coefficient_of_variation"})
PERIOD = (datetime.date(1994, 1, 1), datetime.date(1996, 12, 31))


def _wide_sql(spans: str, ends: str = "s") -> str:
    """All features of the windows ``spans`` (``span``, ``start``, ``stop``, of end date ``e.date``) at the dates of ``ends``, each from its rows and pairs."""
    simple = ", ".join(f"{v} AS {k}" for k, v in _SIMPLE.items())
    query = f"""WITH RECURSIVE {SERIES_SQL}, s AS (SELECT date, value - (SELECT avg(value) FROM series) AS v FROM series),
x AS (SELECT e.date AS "end", d.* FROM {ends} AS e, LATERAL ({spans}) AS d),
w AS (SELECT x.*, s.date, s.v FROM x JOIN s ON s.date BETWEEN x.start AND x.stop),
p AS (SELECT *, CASE WHEN date - lag(date) OVER o = 1 THEN lag(v) OVER o END AS p, CASE WHEN date - lag(date, 2) OVER o = 2 THEN lag(v, 2) OVER o END AS pp, date - min(date) OVER g AS t, min(v) OVER g AS lo, max(v) OVER g AS hi FROM w WINDOW o AS (PARTITION BY "end", span ORDER BY date), g AS (PARTITION BY "end", span)),
r AS (SELECT *, CASE WHEN v > 0 THEN sum(CASE WHEN v > 0 AND NOT coalesce(p > 0, false) THEN 1 ELSE 0 END) OVER o END AS ra, CASE WHEN v < 0 THEN sum(CASE WHEN v < 0 AND NOT coalesce(p < 0, false) THEN 1 ELSE 0 END) OVER o END AS rb FROM p WINDOW o AS (PARTITION BY "end", span ORDER BY date)),
z AS (SELECT *, CASE WHEN ra IS NOT NULL THEN count(*) OVER (PARTITION BY "end", span, ra) END AS sa, CASE WHEN rb IS NOT NULL THEN count(*) OVER (PARTITION BY "end", span, rb) END AS sb FROM r),
a AS (SELECT "end", span, start, stop, CAST(stop - start + 1 AS BIGINT) AS days, count(*) AS n, {simple} FROM z GROUP BY ALL),
m AS (SELECT "end", span, median(abs(v - median)) AS mad FROM z JOIN a USING ("end", span) GROUP BY ALL),
b AS (SELECT "end", span, len(list_filter(range(1, 10), lambda b: v >= lo + b * ((hi - lo) / 10))) AS bin, count(*) AS c FROM z GROUP BY ALL),
h AS (SELECT "end", span, CASE WHEN count(*) > 1 THEN -sum(s * log2(s)) ELSE 0 END AS shannon_entropy FROM (SELECT *, c / sum(c) OVER (PARTITION BY "end", span) AS s FROM b) GROUP BY ALL),
q AS (SELECT i."end", i.span, j.v - i.v AS rise, j.date - i.date AS run FROM w AS i JOIN w AS j ON i."end" = j."end" AND i.span = j.span AND j.date > i.date),
k AS (SELECT "end", span, list_sort(list(rise / run)) AS slopes, median(rise / run) AS theil_sen_slope, CAST(sum(sign(rise)) AS BIGINT) AS s, count(*) AS pairs, count(*) FILTER (rise = 0) AS tied FROM q GROUP BY ALL),
c AS (SELECT "end", span, sum(c * (c - 1) * (2 * c + 5)) AS terms FROM (SELECT "end", span, v, count(*) AS c FROM w GROUP BY ALL) GROUP BY ALL),
e AS (SELECT 1 AS m, [CAST(1 AS DOUBLE)] AS share UNION ALL SELECT m + 1, list_transform(range(1, m * (m + 1) // 2 + 2), lambda i: list_sum(share[greatest(1, i - m):i]) / (m + 1)) FROM e WHERE m < 33),
y AS (SELECT a."end", a.span, n, slopes, theil_sen_slope, s, pairs, tied, (n * (n - 1) * (2 * n + 5) - terms) / 18 AS variance, (pairs - abs(s)) // 2 AS fewer, abs(s) / sqrt(2 * nullif((n * (n - 1) * (2 * n + 5) - terms) / 18, 0)) AS z
  FROM a JOIN k USING ("end", span) JOIN c USING ("end", span)),
t AS (SELECT "end", span, theil_sen_slope, s / nullif(sqrt(CAST(pairs - tied AS DOUBLE) * pairs), 0) AS mann_kendall_tau,
  CASE WHEN variance > 0 THEN slopes[greatest(CAST(round_even((pairs - 1.959963984540054 * sqrt(variance)) / 2, 0) AS BIGINT), 1)] END AS theil_sen_ci_lower,
  CASE WHEN variance > 0 THEN slopes[least(CAST(round_even((pairs + 1.959963984540054 * sqrt(variance)) / 2, 0) AS BIGINT), pairs - 1) + 1] END AS theil_sen_ci_upper,
  CASE WHEN tied = 0 AND n <= 33 THEN least(1, 2 * list_sum(share[1:fewer + 1])) WHEN tied = 0 AND fewer <= 1 THEN 0 WHEN z = 0 THEN 1 WHEN z > 4 THEN 0
    WHEN variance > 0 THEN 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 90), lambda i: exp(2 * i * ln(2) + (2 * i + 1) * ln(z) + lgamma(i + 1) - lgamma(2 * i + 2)))) END AS mann_kendall_p_value
  FROM y LEFT JOIN e ON m = n),
f AS (SELECT "end", span, n, f, (real * real + imaginary * imaginary) * CASE WHEN 2 * f = n THEN 1 ELSE 2 END AS power FROM (
  SELECT "end", span, n, f, sum(d * cos(2 * pi() * f * i / n)) AS real, sum(d * sin(2 * pi() * f * i / n)) AS imaginary
  FROM (SELECT "end", span, n, v - mean AS d, row_number() OVER (PARTITION BY "end", span ORDER BY date) - 1 AS i FROM w JOIN a USING ("end", span) WHERE n = days AND n >= 30 AND minimum < maximum) AS u, unnest(range(1, n // 2 + 1)) AS r(f) GROUP BY "end", span, n, f) AS sums),
l AS (SELECT "end", span, sum(power) / (n * n) AS spectral_variance, 1 / (arg_max(f, power) * (CAST(1 AS DOUBLE) / n)) AS dominant_period, sum(CASE WHEN f * (CAST(1 AS DOUBLE) / n) <= 0.1 THEN power ELSE 0 END) / sum(power) AS low_frequency_power_fraction, sum(CASE WHEN f * (CAST(1 AS DOUBLE) / n) > 0.1 THEN power ELSE 0 END) / sum(power) AS high_frequency_power_fraction FROM f GROUP BY "end", span, n)
SELECT a.*, p75 - p25 AS iqr, p90 - p10 AS p90_minus_p10, mad, CASE WHEN lag1_autocorrelation > 0 AND lag1_autocorrelation < 1 - 1e-9 THEN -1 / ln(lag1_autocorrelation) END AS decorrelation_time, shannon_entropy,
  theil_sen_slope, theil_sen_ci_lower, theil_sen_ci_upper, mann_kendall_tau, mann_kendall_p_value, spectral_variance, dominant_period, low_frequency_power_fraction, high_frequency_power_fraction
FROM a JOIN m USING ("end", span) JOIN h USING ("end", span) JOIN t USING ("end", span) LEFT JOIN l USING ("end", span) WHERE n >= 5"""
    return rounded(query, ", ".join(_ALL), '"end", CAST(span AS BIGINT) AS span, start, stop, days, n')


def temporal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the windows 7, 15, 30 and 90 at every date, a row a window."""
    wide = temporal.wide_features(_series(spark, sf_dir))
    return report(wide.where("n >= 5").select("end", "span", "start", "stop", "days", "n", *_ALL))


TEMPORAL_WINDOWS = _wide_sql("SELECT span, e.date - CAST(width - 1 AS INTEGER) AS start, e.date AS stop FROM (VALUES (0, 7), (1, 15), (2, 30), (3, 90)) AS v(span, width)")


def temporal_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the window of all dates, and of a period, as they stood on the last date of each quarter."""
    quarter = Window.partitionBy("metric", F.trunc("date", "quarter"))
    series = _series(spark, sf_dir).withColumn("wanted", F.col("date") == F.max("date").over(quarter))
    wide = temporal.wide_features(series, windows=(temporal.ALL, PERIOD))
    return report(wide.where("n >= 5").select("end", "span", "start", "stop", "days", "n", *_ALL))


TEMPORAL_QUARTERS = _wide_sql(
    f"SELECT 0 AS span, (SELECT min(date) FROM s) AS start, e.date AS stop UNION ALL SELECT 1, DATE '{PERIOD[0]}', least(e.date, DATE '{PERIOD[1]}')",
    "(SELECT max(date) AS date FROM s GROUP BY date_trunc('quarter', date))",
)


def temporal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 48 features of every end date and production window in the long form with status and reason."""
    return report(temporal.feature_table(_series(spark, sf_dir), windows=(*temporal.WINDOWS, temporal.ALL)))


def exceedance_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(temporal.runs(_series(spark, sf_dir), F.col("value") > 0).drop("run"))


EXCEEDANCE_RUNS = f"""WITH {SERIES_SQL}, s AS (SELECT date, value > (SELECT avg(value) FROM series) AS up FROM series),
g AS (SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS island FROM s WHERE up) SELECT min(date) AS first, max(date) AS last, count(*) AS length FROM g GROUP BY island"""


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.report(full_grid(grid_cells(spark, sf_dir, 20, 20)))
    return report(out.select(*[c for c in out.columns if c not in ("errors", "warnings")], F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings")))


QUALITY_REPORT = rounded(
    f"""WITH {grid_sql(20, 20)}, {FULL_SQL}, d AS (SELECT date, count(*) AS n, count(value) AS f, coalesce(min(value) = max(value), false) AS k, sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) ELSE 0 END) AS vw, sum(cos(radians(lat))) AS w FROM full_cells GROUP BY date),
s AS (SELECT *, date - lag(date) OVER (ORDER BY date) AS step FROM d),
o AS (SELECT min(date) AS start_date, max(date) AS end_date, count(*) AS number_of_dates, min(step) AS minimum_days, quantile_cont(step, 0.5) AS median_days, max(step) AS maximum_days, sum(f) / sum(n) AS valid_data_fraction, sum(vw) / sum(w) AS weighted_spatial_coverage, count(*) FILTER (k) AS constant_field_dates, count(*) FILTER (f = 0) AS all_nan_dates FROM s)
SELECT *, '' AS errors, concat_ws('; ', CASE WHEN minimum_days <> 1 OR maximum_days <> 1 THEN 'Temporal intervals are irregular' END, CASE WHEN maximum_days > 2 THEN 'Maximum temporal gap exceeds 2 days' END, CASE WHEN number_of_dates < 10 THEN 'Too few observations are available' END, CASE WHEN weighted_spatial_coverage < 0.8 THEN 'Weighted valid coverage is below the minimum' END) AS warnings,
CASE WHEN minimum_days <> 1 OR maximum_days <> 1 OR number_of_dates < 10 OR weighted_spatial_coverage < 0.8 THEN 'warning' ELSE 'valid' END AS overall_status FROM o""",
    "median_days, valid_data_fraction, weighted_spatial_coverage",
    "start_date, end_date, number_of_dates, minimum_days, maximum_days, constant_field_dates, all_nan_dates, errors, warnings, overall_status",
)


def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(regional.block_means(full_grid(grid_cells(spark, sf_dir, 20, 20)), 3))


BLOCK_MEANS = rounded(
    f"""WITH {grid_sql(20, 20)}, {FULL_SQL}, b AS (SELECT date, row // 3 AS row, col // 3 AS col, avg(lat) AS lat, avg(lon) AS lon, sum(value * cos(radians(lat))) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) END) AS m, sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) ELSE 0 END) / sum(cos(radians(lat))) AS valid_coverage FROM full_cells GROUP BY ALL)
SELECT date, row, col, lat, lon, CASE WHEN valid_coverage >= 0.8 THEN m END AS value, valid_coverage FROM b""",
    "lat, lon, value, valid_coverage",
    "date, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col",
)

BOXES = (("west", "West box", (-10.0, -4.0), (-90.0, -85.0)), ("east", "East box", (-7.0, 1.0), (-86.0, -79.0)))
_BOX_SQL = "boxes AS (SELECT * FROM (VALUES ('west', 'West box', -10.0, -4.0, -90.0, -85.0), ('east', 'East box', -7.0, 1.0, -86.0, -79.0)) AS t(region_id, region_label, south, north, west, east))"


def regional_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = full_grid(grid_cells(spark, sf_dir, 12, 12))
    boxes = regional.region_table(spark, BOXES)
    means = regional.regional_means(cells, boxes, minimum_coverage=0.5).select("date", "region_id", F.col("mean_sst_c").alias("value"))
    return report(regional.regional_indices(cells, boxes, regional.regional_daily_climatology(means)))


_REGION_CLIM = CLIMATOLOGY.replace("row, col", "region_id, 0 AS z").replace("USING (region_id, 0 AS z, doy)", "USING (region_id, doy)").replace("FROM cells", "FROM means").replace("SELECT region_id, 0 AS z, doy, n,", "SELECT region_id, doy, n,")
_REGION_MEANS = "SELECT date, region_id, region_label, sum(value * cos(radians(lat))) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) END) AS m, sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) ELSE 0 END) / sum(cos(radians(lat))) AS cov, count(value) AS vc, count(*) AS tc FROM full_cells JOIN boxes ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY ALL"
REGIONAL_INDICES = rounded(
    f"""WITH {GRID}, {FULL_SQL}, {_BOX_SQL}, rm AS ({_REGION_MEANS}), means AS (SELECT date, region_id, CASE WHEN cov >= 0.5 THEN m END AS value FROM rm), {_REGION_CLIM},
j AS (SELECT r.date, r.region_id, region_label, CASE WHEN cov >= 0.8 THEN m END AS mean_sst_c, cov AS valid_coverage, vc AS valid_cell_count, tc AS total_cell_count, clim_mean, clim_std, clim_p90 FROM rm r LEFT JOIN clim c ON c.region_id = r.region_id AND c.doy = {STABLE_DAY})
SELECT date, region_id, region_label, mean_sst_c, valid_coverage, valid_cell_count, total_cell_count, 'pacific_context' AS source_domain, 'unknown' AS source_mode, CASE WHEN mean_sst_c IS NOT NULL THEN clim_mean END AS climatological_mean_c, mean_sst_c - clim_mean AS anomaly_c, CASE WHEN clim_std > 0 THEN (mean_sst_c - clim_mean) / clim_std END AS standardized_anomaly, CASE WHEN mean_sst_c IS NOT NULL THEN clim_p90 END AS threshold_p90_c, mean_sst_c > clim_p90 AS exceeds_p90,
CASE WHEN mean_sst_c IS NULL THEN 'not_calculated_no_compatible_climatology' WHEN clim_std > 0 THEN 'calculated' ELSE 'partial' END AS anomaly_status, CASE WHEN mean_sst_c IS NULL THEN 'not_available' ELSE 'daily' END AS climatology_method FROM j""",
    "mean_sst_c, valid_coverage, climatological_mean_c, anomaly_c, standardized_anomaly, threshold_p90_c",
    "date, region_id, region_label, valid_cell_count, total_cell_count, source_domain, source_mode, exceeds_p90, anomaly_status, climatology_method",
)


def regional_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regional sums of two tiles, added up."""
    cells = grid_cells(spark, sf_dir)
    boxes = regional.region_table(spark, BOXES)
    tiles = [regional.regional_partials(cells.where(c), boxes) for c in ("col < 6", "col >= 6")]
    return report(regional.merged_partials(tiles[0].unionByName(tiles[1])))


REGIONAL_PARTIALS = rounded(
    f"WITH {GRID}, {_BOX_SQL} SELECT date, region_id, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS value, 1.0 AS valid_coverage, CAST(count(value) AS BIGINT) AS valid_cells, CAST(count(*) AS BIGINT) AS total_cells FROM cells JOIN boxes ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY ALL",
    "value, valid_coverage",
    "date, region_id, valid_cells, total_cells",
)


def domain_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = full_grid(grid_cells(spark, sf_dir, 6, 6))
    return report(regional.domain_anomalies(cells, climatology.daily_statistics(cells)))


DOMAIN_ANOMALIES = rounded(
    f"""WITH {grid_sql(6, 6)}, {FULL_SQL}, {CLIMATOLOGY}, v AS (SELECT *, count(value) OVER (PARTITION BY date) / count(*) OVER (PARTITION BY date) AS valid_coverage FROM full_cells)
SELECT v.date, v.row, v.col, value, valid_coverage, CASE WHEN valid_coverage >= 0.8 THEN value - clim_mean END AS sst_anomaly_c, CASE WHEN valid_coverage >= 0.8 AND clim_std > 1e-12 THEN (value - clim_mean) / clim_std END AS sst_z_score, CASE WHEN valid_coverage >= 0.8 AND value IS NOT NULL AND clim_p90 IS NOT NULL THEN value < clim_p10 END AS below_p10, CASE WHEN valid_coverage >= 0.8 AND value IS NOT NULL AND clim_p90 IS NOT NULL THEN value > clim_p90 END AS exceeds_p90, CASE WHEN valid_coverage >= 0.8 AND value IS NOT NULL AND clim_p90 IS NOT NULL THEN 'calculated' ELSE 'not_calculated' END AS percentile_status
FROM v LEFT JOIN clim m ON m.row = v.row AND m.col = v.col AND m.doy = {STABLE_DAY}""",
    "value, valid_coverage, sst_anomaly_c, sst_z_score",
    "date, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, below_p10, exceeds_p90, percentile_status",
)


def cell_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid_cells(spark, sf_dir).select("row", "lat").distinct()
    return report(rows.select("row", C.cell_area_km2(F.col("lat"), 1.0, 1.0).alias("area_km2")))


CELL_AREAS = rounded(f"WITH {GRID} SELECT DISTINCT row, 6371.0088 * 6371.0088 * abs(sin(radians(lat + 0.5)) - sin(radians(lat - 0.5))) * radians(1.0) AS area_km2 FROM cells", "area_km2", "CAST(row AS BIGINT) AS row")


def geodesy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and bearing from each grid row to the corner of the grid."""
    rows = grid_cells(spark, sf_dir).select("row", "col", "lat", "lon").distinct()
    a, b = F.lit(-10.0), F.lit(-90.0)
    return report(rows.select("row", "col", C.haversine_km(a, b, F.col("lat"), F.col("lon")).alias("km"), C.bearing_degrees(a, b, F.col("lat"), F.col("lon")).alias("bearing")), 5)


GEODESY = rounded(
    f"""WITH {GRID}, g AS (SELECT DISTINCT row, col, lat, lon FROM cells) SELECT row, col, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat + 10) / 2), 2) + cos(radians(-10.0)) * cos(radians(lat)) * pow(sin(radians(lon + 90) / 2), 2))) AS km,
CASE WHEN row = 0 AND col = 0 THEN NULL ELSE (degrees(atan2(sin(radians(lon + 90)) * cos(radians(lat)), cos(radians(-10.0)) * sin(radians(lat)) - sin(radians(-10.0)) * cos(radians(lat)) * cos(radians(lon + 90)))) + 360) % 360 END AS bearing FROM g""",
    "km, bearing",
    "CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col",
    5,
)


def stable_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily_series(spark, sf_dir).select("date")
    return report(days.select("date", C.stable_day(F.col("date")).alias("doy"), C.circular_day_distance(C.stable_day(F.col("date")), F.lit(10)).alias("from_day_10")))


STABLE_DAYS = f"WITH {SERIES_SQL} SELECT date, {STABLE_DAY} AS doy, least(abs({STABLE_DAY} - 10), 366 - abs({STABLE_DAY} - 10)) AS from_day_10 FROM series"


def describe_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(cell_sources.describe(grid_cells(spark, sf_dir)))


DESCRIBE_GRID = rounded(f"WITH {GRID} SELECT count(DISTINCT lat) AS n_lat, count(DISTINCT lon) AS n_lon, count(DISTINCT date) AS n_dates, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, max(date) AS latest, count(value) AS finite FROM cells", "south, north, west, east", "n_lat, n_lon, n_dates, latest, finite")


def box_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_cells(spark, sf_dir)
    return report(cells.where(C.inside_box(F.col("lat"), F.col("lon"), (-8.0, -3.0), (-88.0, -84.0))).select("date", "row", "col", "value"))


BOX_SUBSET = rounded(f"WITH {GRID} SELECT date, row, col, value FROM cells WHERE lat BETWEEN -8 AND -3 AND lon BETWEEN -88 AND -84", "value", "date, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col")


def temporal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(overview.temporal_segments(daily_series(spark, sf_dir), ["value"]))


TEMPORAL_SEGMENTS = rounded(f"WITH {SERIES_SQL}, g AS (SELECT *, coalesce(date - lag(date) OVER (ORDER BY date) > 1, false) AS cut FROM series) SELECT date, value, CAST(sum(CAST(cut AS INTEGER)) OVER (ORDER BY date) AS BIGINT) AS segment_id FROM g", "value", "date, segment_id")


def endpoint_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(facts.endpoint_changes(daily_series(spark, sf_dir)))


ENDPOINT_CHANGES = rounded(f"WITH {SERIES_SQL} SELECT a.date, d.days, a.value - b.value AS change FROM series a CROSS JOIN (SELECT unnest([1, 7, 15, 30]) AS days) d LEFT JOIN series b ON b.date = a.date - d.days", "change", "date, CAST(days AS BIGINT) AS days")


def top_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_cells(spark, sf_dir).withColumn("cell", F.format_string("%02d-%02d", "row", "col"))
    return report(overview.top_per_date(cells.select("date", "cell", "value"), "value", "cell", 3))


TOP_DAYS = rounded(f"WITH {GRID}, c AS (SELECT date, lpad(CAST(row AS VARCHAR), 2, '0') || '-' || lpad(CAST(col AS VARCHAR), 2, '0') AS cell, value FROM cells) SELECT *, row_number() OVER (PARTITION BY date ORDER BY value DESC, cell) AS rank FROM c QUALIFY rank <= 3", "value", "date, cell, rank")


def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("text_id"), "text")
    return report(facts.number_tokens(docs).select("text_id", "position", "token"))


NUMBER_TOKENS = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([-+]?[0-9]+(?:[.,][0-9]+)?(?: *%)?)', 1)) AS token FROM documents) SELECT doc_id AS text_id, token FROM t"""


def numeric_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about regional means, of which every seventh is wrong, among dates, windows and names."""
    means = daily.area_means(grid_cells(spark, sf_dir)).select(F.date_format("date", "yyyyMMdd").alias("fact_id"), "date", F.col("mean").alias("value"), F.lit("degC").alias("unit"), F.lit(2).alias("precision"))
    shown = F.when(F.dayofyear("date") % 7 == 0, F.col("value") + 5).otherwise(F.col("value"))
    texts = means.select(F.col("fact_id").alias("text_id"), F.concat(F.lit("On "), F.date_format("date", "yyyy-MM-dd"), F.lit(" the 7-day report of 1991-2020 gave a mean of "), F.format_string("%.2f", shown), F.lit(" in track TRK000012, above percentile 90.")).alias("text"))
    cited = means.select(F.col("fact_id").alias("text_id"), "fact_id")
    return facts.unsupported_numbers(texts, cited, facts.registry(means.select("fact_id", "value", "unit", "precision"))).select("text_id")


NUMERIC_CLAIMS = f"WITH {GRID} SELECT DISTINCT strftime(date, '%Y%m%d') AS text_id FROM cells WHERE dayofyear(date) % 7 = 0"


def direction_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = facts.endpoint_changes(daily_series(spark, sf_dir), (7,))
    return changes.select("date", C.direction_of(F.col("change"), 5.0).alias("direction"))


DIRECTION_CODES = f"WITH {SERIES_SQL} SELECT a.date, CASE WHEN b.value IS NULL THEN 'insufficient_data' WHEN abs(a.value - b.value) <= 5 THEN 'stable' WHEN a.value > b.value THEN 'increasing' ELSE 'decreasing' END AS direction FROM series a LEFT JOIN series b ON b.date = a.date - 7"


def rolling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the stream table by day and type, as the batch twin of the streaming mean."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("date"), "event_type", "value")
    days = rows.groupBy("event_type", "date").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return report(days.withColumn("seven_day_mean", F.avg("mean").over(Window.partitionBy("event_type").orderBy("date").rowsBetween(-6, 0))))


ROLLING_EVENTS = rounded("SELECT event_type, date, mean, n, avg(mean) OVER (PARTITION BY event_type ORDER BY date ROWS 6 PRECEDING) AS seven_day_mean FROM (SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS mean, count(value) AS n FROM events GROUP BY ALL)", "mean, seven_day_mean", "event_type, date, n")

def _coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coast vertices: two lines through the suppliers by key."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    lat, lon = -10.5 + F.pmod(F.col("s_suppkey") * 7, F.lit(50)) * 0.05, -91.0 + F.pmod(F.col("s_nationkey") * 11 + F.col("s_suppkey"), F.lit(60)) * 0.05
    return rows.select((F.col("s_suppkey") % 2).alias("line"), F.col("s_suppkey").alias("place"), lat.alias("lat"), lon.alias("lon"))


def coastal_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid points within 60 nautical miles of the coast, with their distance from it."""
    points = grid_cells(spark, sf_dir, 20, 20).select("row", "col", "lat", "lon").distinct()
    return report(coast.coast_distance(points, coast.arcs(_coast(spark, sf_dir))))


#: All points against all arcs, by latitudes, longitudes and bearings from the arc's first end.
COASTAL_CORRIDOR = rounded(
    f"""WITH {grid_sql(20, 20)}, point AS (SELECT DISTINCT row, col, lat, lon, radians(lat) AS p, radians(lon) AS l FROM cells),
vertex AS (SELECT s_suppkey % 2 AS line, s_suppkey AS place, radians(-10.5 + (s_suppkey * 7) % 50 * 0.05) AS p, radians(-91.0 + (s_nationkey * 11 + s_suppkey) % 60 * 0.05) AS l FROM supplier),
arc AS (SELECT p AS p1, l AS l1, lead(p) OVER o AS p2, lead(l) OVER o AS l2 FROM vertex WINDOW o AS (PARTITION BY line ORDER BY place)),
h AS (SELECT row, col, lat, lon, 2 * asin(least(1, sqrt(sin((p - p1) / 2) ^ 2 + cos(p) * cos(p1) * sin((l - l1) / 2) ^ 2))) AS d13, 2 * asin(least(1, sqrt(sin((p - p2) / 2) ^ 2 + cos(p) * cos(p2) * sin((l - l2) / 2) ^ 2))) AS d23,
  2 * asin(least(1, sqrt(sin((p2 - p1) / 2) ^ 2 + cos(p2) * cos(p1) * sin((l2 - l1) / 2) ^ 2))) AS d12, atan2(sin(l - l1) * cos(p), cos(p1) * sin(p) - sin(p1) * cos(p) * cos(l - l1)) AS b13, atan2(sin(l2 - l1) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(l2 - l1)) AS b12
  FROM point, arc WHERE p2 IS NOT NULL),
x AS (SELECT *, asin(sin(d13) * sin(b13 - b12)) AS off, atan2(sin(d13) * cos(b13 - b12), cos(d13)) AS along FROM h)
SELECT row, col, lat, lon, min({C.EARTH_RADIUS_KM} * CASE WHEN along BETWEEN 0 AND d12 THEN abs(off) ELSE least(d13, d23) END) AS coast_km FROM x GROUP BY ALL HAVING min({C.EARTH_RADIUS_KM} * CASE WHEN along BETWEEN 0 AND d12 THEN abs(off) ELSE least(d13, d23) END) <= 111.12""",
    "lat, lon, coast_km",
    "CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col",
)


QUERIES = {
    "temporal_features": (temporal_features, TEMPORAL_FEATURES), "trend_pairs": (trend_pairs, TREND_PAIRS), "temporal_windows": (temporal_windows, TEMPORAL_WINDOWS), "temporal_quarters": (temporal_quarters, TEMPORAL_QUARTERS), "temporal_table": (temporal_table, None), "exceedance_runs": (exceedance_runs, EXCEEDANCE_RUNS), "quality_report": (quality_report, QUALITY_REPORT),
    "block_means": (block_means, BLOCK_MEANS), "regional_indices": (regional_indices, REGIONAL_INDICES), "regional_partials": (regional_partials, REGIONAL_PARTIALS), "domain_anomalies": (domain_anomalies, DOMAIN_ANOMALIES), "cell_areas": (cell_areas, CELL_AREAS),
    "geodesy": (geodesy, GEODESY), "stable_days": (stable_days, STABLE_DAYS), "describe_grid": (describe_grid, DESCRIBE_GRID), "box_subset": (box_subset, BOX_SUBSET), "temporal_segments": (temporal_segments, TEMPORAL_SEGMENTS), "endpoint_changes": (endpoint_changes, ENDPOINT_CHANGES),
    "top_days": (top_days, TOP_DAYS), "coastal_corridor": (coastal_corridor, COASTAL_CORRIDOR), "number_tokens": (number_tokens, None), "numeric_claims": (numeric_claims, NUMERIC_CLAIMS), "direction_codes": (direction_codes, DIRECTION_CODES), "rolling_events": (rolling_events, ROLLING_EVENTS),
}
