"""The series bank: daily spatial features of several variables in one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.functions import statistics as S

#: Features: name, family, how the unit follows from the variable's.  Fixed values.
FEATURES = (
    ("weighted_mean", "state", "same"), ("weighted_median", "state", "same"), ("spatial_minimum", "state", "same"),
    ("spatial_maximum", "state", "same"), ("spatial_p10", "state", "same"), ("spatial_p25", "state", "same"),
    ("spatial_p75", "state", "same"), ("spatial_p90", "state", "same"), ("valid_cell_fraction", "quality", "fraction"),
    ("weighted_valid_coverage", "quality", "fraction"), ("weighted_standard_deviation", "heterogeneity", "same"),
    ("weighted_mad", "heterogeneity", "same"), ("weighted_iqr", "heterogeneity", "same"), ("p90_minus_p10", "heterogeneity", "same"),
    ("latitudinal_gradient", "gradient", "per_degree"), ("longitudinal_gradient", "gradient", "per_degree"),
    ("valid_observation_count", "quality", "count"), ("missing_fraction", "quality", "fraction"), ("constant_field_flag", "quality", "flag"),
)
CENTROID = (("warm_centroid_latitude", "degrees_north"), ("warm_centroid_longitude", "degrees_east"))
GATED = ("state", "heterogeneity", "gradient")


def unit_for(unit: str, kind: str) -> str:
    return {"same": unit, "per_degree": f"{unit} per degree", "fraction": "1", "flag": "1", "count": "count"}[kind]


def daily_features(cells: DataFrame, *, warm_threshold: float = 2.0) -> DataFrame:
    """A wide row of features per ``variable`` and ``date``; cells have ``variable, date, lat, lon, value``.

    Two passes: means and quantiles, then what is measured from them.
    """
    by = ["variable", "date"]
    rows = cells.withColumn("w", C.latitude_weight(F.col("lat")))
    v, w = F.col("value"), F.col("w")
    first = rows.groupBy(*by).agg(
        S.weighted_mean(v, w).alias("weighted_mean"), F.min(v).alias("spatial_minimum"), F.max(v).alias("spatial_maximum"),
        (F.count(v) / F.count(F.lit(1))).alias("valid_cell_fraction"), S.coverage(v, w).alias("weighted_valid_coverage"),
        F.count(v).cast("double").alias("valid_observation_count"), (1.0 - F.count(v) / F.count(F.lit(1))).alias("missing_fraction"),
        F.when(F.min(v) == F.max(v), 1.0).otherwise(0.0).alias("constant_field_flag"),
        S.weighted_mean(F.when(v.isNotNull(), F.col("lat")), w).alias("mean_lat"), S.weighted_mean(F.when(v.isNotNull(), F.col("lon")), w).alias("mean_lon"),
        *[(F.sum(F.when(v >= warm_threshold, w * F.greatest(v, F.lit(0.0)) * F.col(c))) / F.nullif(F.sum(F.when(v >= warm_threshold, w * F.greatest(v, F.lit(0.0)))), F.lit(0.0))).alias(n) for c, (n, _) in zip(("lat", "lon"), CENTROID, strict=True)],
    )
    quantiles = S.weighted_quantiles(rows, by, "value", "w", {"weighted_median": 0.5, "spatial_p10": 0.1, "spatial_p25": 0.25, "spatial_p75": 0.75, "spatial_p90": 0.9})
    known = first.join(quantiles, by, "left")
    again = rows.join(known.select(*by, "weighted_mean", "weighted_median", "mean_lat", "mean_lon"), by)
    second = again.groupBy(*by).agg(
        S.weighted_deviation(v, w, F.col("weighted_mean")).alias("weighted_standard_deviation"),
        S.gradient(v, F.col("lat"), w, F.col("weighted_mean"), F.col("mean_lat")).alias("latitudinal_gradient"),
        S.gradient(v, F.col("lon"), w, F.col("weighted_mean"), F.col("mean_lon")).alias("longitudinal_gradient"),
    )
    mad = S.weighted_quantiles(again.withColumn("apart", F.abs(v - F.col("weighted_median"))), by, "apart", "w", {"weighted_mad": 0.5})
    wide = known.join(second, by).join(mad, by, "left")
    return wide.withColumn("weighted_iqr", F.col("spatial_p75") - F.col("spatial_p25")).withColumn("p90_minus_p10", F.col("spatial_p90") - F.col("spatial_p10"))


def gate(value: Column, family: str, coverage: Column, minimum: float) -> tuple[Column, Column, Column]:
    """Value, status and reason after the coverage gate."""
    if family not in GATED:
        low = F.lit(False)
    else:
        low = coverage.isNull() | (coverage < minimum)
    reason = F.when(low, F.format_string(f"Valid coverage %.3f is below the minimum {minimum:.3f}", F.coalesce(coverage, F.lit(0.0))))
    gone = low | value.isNull()
    return F.when(~gone, value), F.when(gone, "not_calculated").otherwise("valid"), F.when(~low & value.isNull(), "The value is undefined").otherwise(reason)


def series_bank(cells: DataFrame, *, units: dict[str, str], minimum_coverage: float = 0.8, warm_threshold: float = 2.0, climatology_method: str | None = None, data_mode: str = "unknown") -> DataFrame:
    """The long table: one row per date and metric ``<variable>.<feature>``."""
    wide = daily_features(cells, warm_threshold=warm_threshold)
    unit = F.create_map(*[F.lit(x) for k, v in units.items() for x in (k, v)])[F.col("variable")]
    entries = []
    for name, family, kind in FEATURES:
        value, status, reason = gate(F.col(name), family, F.col("weighted_valid_coverage"), minimum_coverage)
        own = {"same": unit, "per_degree": F.concat(unit, F.lit(" per degree"))}.get(kind, F.lit({"fraction": "1", "flag": "1"}.get(kind, kind)))
        entries.append(F.struct(F.lit(family).alias("family"), F.lit(name).alias("feature"), value.alias("value"), own.alias("unit"), status.alias("status"), reason.alias("reason")))
    warm = []
    for name, own in CENTROID:
        low = F.col("weighted_valid_coverage") < minimum_coverage
        value = F.when(~low, F.col(name))
        reason = F.when(low, "Insufficient coverage").when(value.isNull(), f"No valid cells meet the warm-anomaly threshold of {warm_threshold:g} °C")
        warm.append(F.struct(F.lit("centroid").alias("family"), F.lit(name).alias("feature"), value.alias("value"), F.lit(own).alias("unit"), F.when(value.isNull(), "not_calculated").otherwise("valid").alias("status"), reason.alias("reason")))
    every = F.when(F.col("variable") == "anomaly", F.array(*entries, *warm)).otherwise(F.array(*entries))
    long = wide.select("variable", "date", F.col("valid_observation_count").cast("long").alias("n_observations"), F.col("weighted_valid_coverage").alias("valid_coverage"), F.explode(every).alias("e"))
    return long.select(
        "date", "e.family", F.concat_ws(".", "variable", "e.feature").alias("metric"), "e.value", "e.unit", "e.status", "e.reason",
        "n_observations", "valid_coverage", F.lit(1).alias("window_days"), F.lit(climatology_method).cast("string").alias("climatology_method"), F.lit(data_mode).alias("data_mode"),
    )
