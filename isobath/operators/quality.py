"""Quality control of gridded input: one report row, gates of results, and duplicate policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.functions import statistics as S


def resolve_duplicates(cells: DataFrame, policy: str = "error", keys: list[str] = ["date", "row", "col"]) -> DataFrame:
    """One value per cell and date: refuse, the first or last by ``ordinal``, or the mean."""
    group = cells.groupBy(*keys)
    if policy == "mean":
        return group.agg(F.avg("value").alias("value"))
    if policy in ("first", "last"):
        pick = F.min_by if policy == "first" else F.max_by
        return group.agg(pick(F.struct("value"), "ordinal")["value"].alias("value"))
    if policy != "error":
        raise ValueError("the policy is error, first, last or mean")
    return group.agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a cell occurs more than once on a date"))).otherwise(F.first("value")).cast("double").alias("value"))


def dates_report(cells: DataFrame) -> DataFrame:
    """Per date: cells, finite cells, whether the field is constant or empty, and weighted coverage."""
    rows = cells.withColumn("infinite", F.abs("value") == float("inf")).withColumn("value", C.finite(F.col("value"))).withColumn("w", C.latitude_weight(F.col("lat")))
    return rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("cells"), F.count("value").alias("finite"), F.coalesce(F.min("value") == F.max("value"), F.lit(False)).alias("constant"), (F.count("value") == 0).alias("empty"),
        F.bool_or(F.coalesce("infinite", F.lit(False))).alias("infinite"), F.sum(F.coalesce(S.weight_of(F.col("value"), F.col("w")), F.lit(0.0))).alias("valid_weight"), F.sum("w").alias("weight"),
    )


def report(cells: DataFrame, *, maximum_gap_days: int = 2, minimum_observations: int = 10, minimum_coverage: float = 0.8, irregular_allowed: bool = True) -> DataFrame:
    """One row: range, intervals, fractions, constant and empty dates, warnings, errors and status."""
    daily = dates_report(cells)
    steps = daily.withColumn("step", F.datediff("date", F.lag("date").over(Window.orderBy("date"))))  # one row per date
    out = steps.agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("number_of_dates"), F.min("step").alias("minimum_days"), F.percentile("step", 0.5).alias("median_days"), F.max("step").alias("maximum_days"),
        (F.sum("finite") / F.sum("cells")).alias("valid_data_fraction"), (F.sum("valid_weight") / F.sum("weight")).alias("weighted_spatial_coverage"), F.count_if("constant").alias("constant_field_dates"), F.count_if("empty").alias("all_nan_dates"), F.bool_or("infinite").alias("infinite"),
    )
    irregular = F.coalesce((F.col("minimum_days") != 1) | (F.col("maximum_days") != 1), F.lit(False))
    errors = F.array_compact(F.array(F.when(F.col("infinite"), "Field contains infinite values"), F.when(F.col("all_nan_dates") == F.col("number_of_dates"), "Field contains no finite observations"), F.when(irregular & F.lit(not irregular_allowed), "Temporal intervals are irregular")))
    warnings = F.array_compact(F.array(
        F.when(irregular & F.lit(irregular_allowed), "Temporal intervals are irregular"), F.when(F.col("maximum_days") > maximum_gap_days, f"Maximum temporal gap exceeds {maximum_gap_days} days"),
        F.when(F.col("number_of_dates") < minimum_observations, "Too few observations are available"), F.when(F.col("weighted_spatial_coverage") < minimum_coverage, "Weighted valid coverage is below the minimum"),
    ))
    return out.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("overall_status", F.when(F.size("errors") > 0, "invalid").when(F.size("warnings") > 0, "warning").otherwise("valid")).drop("infinite")


def dataset_problems(cells: DataFrame) -> DataFrame:
    """``problem``, one row for each reason why the cells can't be used; none if they can."""
    missing = [c for c in ("date", "lat", "lon", "value") if c not in cells.columns]
    if missing:
        return cells.sparkSession.createDataFrame([(f"Column {c} is missing",) for c in missing], "problem string")
    found = cells.agg(F.count("date").alias("dates"), F.count(C.finite(F.col("value"))).alias("finite"))
    problems = F.array_compact(F.array(F.when(F.col("dates") == 0, "There are no dates"), F.when(F.col("finite") == 0, "There are no finite values")))
    return found.select(F.explode(problems).alias("problem"))


def coverage_gate(value: Column, coverage: Column, minimum: float) -> Column:
    """``value``, ``status``, ``reason``: nothing where too little is valid."""
    low = coverage.isNull() | (coverage < minimum)
    reason = F.format_string(f"Valid coverage %.3f is below {minimum:.3f}", F.coalesce(coverage, F.lit(0.0)))
    return F.struct(F.when(~low, value).alias("value"), F.when(low, "not_calculated").otherwise("valid").alias("status"), F.when(low, reason).alias("reason"))


def observation_gate(value: Column, n: Column, minimum: int) -> Column:
    few = n < minimum
    return F.struct(F.when(~few, value).alias("value"), F.when(few, "not_calculated").otherwise("valid").alias("status"), F.when(few, F.format_string(f"Only %d observations; minimum is {minimum}", n)).alias("reason"))


def auxiliary_problems(values: DataFrame, column: str, *, strictly_positive: bool = False) -> DataFrame:
    """Weights, masks or areas that aren't finite or have the wrong sign."""
    x = F.col(column)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0 if strictly_positive else x < 0)
    return values.where(bad)


def coordinates_agree(a: DataFrame, b: DataFrame, coordinate: str, tolerance: float = 1e-6) -> DataFrame:
    """Coordinates of either side that the other lacks, on a lattice of the tolerance."""
    key = lambda df, side: df.select(F.round(F.col(coordinate) / tolerance).cast("long").alias("k"), F.lit(True).alias(side)).distinct()
    return key(a, "left_side").join(key(b, "right_side"), "k", "full").where("left_side IS NULL OR right_side IS NULL").select((F.col("k") * tolerance).alias(coordinate), F.when(F.col("left_side").isNull(), "left").otherwise("right").alias("missing_on"))
