"""Thresholds and events of daily series: segmentation by windows, one row per event.

Series are told apart by ``keys`` (none: one series), so any number is segmented at once; a series'
days are one window partition, a few thousand rows a decade.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.functions import statistics as S


@dataclass(frozen=True)
class EventRule:
    direction: str = "above"
    inclusive: bool = True
    minimum_duration: int = 5
    allowed_gap: int = 0
    maximum_calendar_gap: int = 1
    minimum_coverage: float = 0.8

    def __post_init__(self) -> None:
        if self.direction not in ("above", "below"):
            raise ValueError("direction is 'above' or 'below'")
        if self.minimum_duration < 1 or self.allowed_gap < 0 or self.maximum_calendar_gap < 1 or not 0 <= self.minimum_coverage <= 1:
            raise ValueError("durations and gaps must be positive, coverage a fraction")


def prepared(series: DataFrame, keys: list[str] = [], *, duplicates: str = "error") -> DataFrame:
    """``keys, date, value, valid_coverage`` with one row per day."""
    rows = series.withColumn("date", F.to_date("date")).withColumn("value", C.finite(F.col("value")))
    if "valid_coverage" not in series.columns:
        rows = rows.withColumn("valid_coverage", F.lit(1.0))
    days = rows.groupBy(*keys, "date")
    if duplicates == "mean":
        return days.agg(F.avg("value").alias("value"), F.avg("valid_coverage").alias("valid_coverage"))
    if duplicates in ("first", "last"):
        if "ordinal" not in series.columns:
            raise ValueError("first and last need the order of arrival in column 'ordinal'")
        pick = F.min_by if duplicates == "first" else F.max_by
        return days.agg(*[pick(F.struct(c), "ordinal")[c].alias(c) for c in ("value", "valid_coverage")])
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a date occurs more than once"))).otherwise(F.first("value"))
    return days.agg(once.cast("double").alias("value"), F.first("valid_coverage").alias("valid_coverage"))


def fixed_threshold(series: DataFrame, value: float) -> DataFrame:
    return series.withColumn("threshold", F.lit(float(value)))


def percentile_threshold(series: DataFrame, percentile: float, keys: list[str] = []) -> DataFrame:
    """The exact percentile of the series' own values."""
    if not 0 < percentile < 100:
        raise ValueError("a percentile lies between 0 and 100")
    if not keys:
        own = S.percentiles(series.withColumn("every_row", F.lit(0)), ["every_row"], "value", {"threshold": percentile / 100.0})
        return series.withColumn("every_row", F.lit(0)).join(F.broadcast(own), "every_row", "left").drop("every_row")  # one row
    return series.join(series.groupBy(*keys).agg(F.percentile("value", percentile / 100.0).alias("threshold")), keys)


def climatological_threshold(series: DataFrame, climatology: DataFrame, column: str = "clim_p90") -> DataFrame:
    """The area-weighted regional mean of a climatological column on each day's stable day."""
    regional = climatology.groupBy("doy").agg(S.weighted_mean(F.col(column), C.latitude_weight(F.col("lat"))).alias("threshold"))
    return series.withColumn("doy", C.stable_day(F.col("date"))).join(F.broadcast(regional), "doy", "left").drop("doy")  # 366 rows


def custom_threshold(series: DataFrame, thresholds: DataFrame) -> DataFrame:
    """A series of thresholds aligned by date; days without one have none."""
    once = thresholds.groupBy("date").agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a threshold date occurs more than once"))).otherwise(F.first("threshold")).cast("double").alias("threshold"))
    return series.join(once, "date", "left")


def daily_flags(series: DataFrame, rule: EventRule, keys: list[str] = []) -> DataFrame:
    """Each day with its status and, if it belongs to an event, the event's number in its series.

    Days are numbered; an invalid day or a calendar gap breaks; between exceedances of one event lie
    at most ``allowed_gap`` valid days, which belong to it; events count ``minimum_duration`` days.
    """
    v, t, cover = F.col("value"), F.col("threshold"), F.col("valid_coverage")
    ok = v.isNotNull() & t.isNotNull() & F.coalesce(cover >= rule.minimum_coverage, F.lit(False))
    order = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("date")
    rows = series.withColumn("valid", ok).withColumn("n", F.row_number().over(order)).withColumn("gap_days", F.datediff("date", F.lag("date").over(order)))
    rows = rows.withColumn("exceeds", F.when(ok, C.exceeds(v, t, rule.direction, rule.inclusive))).withColumn("intensity", F.when(ok, C.intensity(v, t, rule.direction)))
    jump = F.coalesce(F.col("gap_days") > rule.maximum_calendar_gap, F.lit(False))
    rows = rows.withColumn("jump", jump).withColumn("block", F.sum((jump | ~F.col("valid")).cast("int")).over(order))
    # the last exceedance before a day, and the next one from it on, within its block
    block = Window.partitionBy(*keys, "block").orderBy("date")
    hit = F.when(F.col("exceeds"), F.col("n"))
    rows = rows.withColumn("before", F.max(hit).over(block.rowsBetween(Window.unboundedPreceding, -1)))
    starts = F.col("exceeds") & (F.col("before").isNull() | (F.col("n") - F.col("before") - 1 > rule.allowed_gap))
    rows = rows.withColumn("run", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(block))
    group = Window.partitionBy(*keys, "block", "run")
    rows = rows.withColumn("last_hit", F.max(hit).over(group))
    inside = F.col("valid") & (F.col("run") > 0) & (F.col("n") <= F.col("last_hit"))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(False))).withColumn("members", F.sum(F.col("inside").cast("int")).over(group))
    rows = rows.withColumn("kept", F.col("inside") & (F.col("members") >= rule.minimum_duration))
    first = F.col("kept") & (F.row_number().over(group.orderBy(F.desc("kept"), "n")) == 1)
    rows = rows.withColumn("first", first).withColumn("event", F.when(F.col("kept"), F.sum(F.col("first").cast("int")).over(order)))
    why = F.when(v.isNull(), "Source value is missing or non-finite").when(t.isNull(), "Active threshold is missing or non-finite").when(~ok, "Valid coverage is below the configured minimum")
    note = F.when(F.col("jump"), F.format_string(f"Temporal discontinuity: %d-day observation gap exceeds maximum {rule.maximum_calendar_gap}", "gap_days"))
    member = Window.partitionBy(*keys, "event").orderBy("date")
    return rows.select(
        *keys, "date", "value", "threshold", F.col("exceeds").alias("exceeds_threshold"), (F.col("kept") & ~F.coalesce("exceeds", F.lit(False))).alias("observed_interruption"),
        "event", F.when(F.col("kept"), F.row_number().over(member)).alias("event_day"), F.when(F.col("kept"), F.datediff("date", F.min("date").over(member)) + 1).alias("event_age_calendar_days"),
        "intensity", "valid_coverage", F.when(~ok, "not_calculated").when(F.col("jump"), "warning").otherwise("valid").alias("status"), F.nullif(F.concat_ws("; ", why, note), F.lit("")).alias("reason"),
    )


def event_id(name: str | Column, number: Column) -> Column:
    prefix = C.slug(F.lit(name)) if isinstance(name, str) else C.slug(name)
    return F.concat(prefix, F.lit("-E"), F.lpad(number.cast("string"), 4, "0"))


def event_metrics(flags: DataFrame, bands: dict[str, float], keys: list[str] = []) -> DataFrame:
    """One row per event: duration, intensity, development and severity."""
    own = [*keys, "event"]
    days = Window.partitionBy(*own).orderBy("date")
    rows = flags.where(F.col("event").isNotNull())
    rate = (F.col("intensity") - F.lag("intensity").over(days)) / F.datediff("date", F.lag("date").over(days))
    rows = rows.withColumn("rate", rate).withColumn("ordinal", F.row_number().over(days))
    rows = rows.withColumn("starts_pause", F.col("observed_interruption") & ~F.coalesce(F.lag("observed_interruption").over(days), F.lit(False)))
    # the sign of the last rate that wasn't zero
    sign = F.when(F.col("rate") != 0, F.signum("rate"))
    rows = rows.withColumn("sign", sign).withColumn("sign_before", F.last("sign", ignorenulls=True).over(days.rowsBetween(Window.unboundedPreceding, -1)))
    peak = F.max(F.struct(F.col("intensity"), (-F.col("ordinal")).alias("o"), F.col("date"), F.col("value"), F.col("threshold")))  # the first of the largest
    out = rows.groupBy(*own).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), peak.alias("peak"), F.count(F.lit(1)).alias("duration_observed_days"),
        F.count_if("exceeds_threshold").alias("exceedance_days"), F.count_if("observed_interruption").alias("interruption_days"), F.avg("valid_coverage").alias("mean_valid_coverage"),
        F.avg("intensity").alias("mean_intensity"), F.max("intensity").alias("maximum_intensity"), F.min("intensity").alias("minimum_intensity"), F.sum("intensity").alias("cumulative_intensity"),
        F.stddev_pop("intensity").alias("intensity_standard_deviation"), F.percentile("intensity", 0.9).alias("p90_intensity"),
        F.min_by("intensity", "date").alias("first_intensity"), F.max_by("intensity", "date").alias("last_intensity"),
        F.greatest(F.max("rate"), F.lit(0.0)).alias("up"), F.greatest(F.max(-F.col("rate")), F.lit(0.0)).alias("down"),
        F.count_if(F.col("sign") != F.col("sign_before")).alias("turns"), F.count_if("starts_pause").alias("number_of_observed_interruptions"),
    )
    several = F.col("duration_observed_days") >= 2
    rise, fall = F.datediff("peak.date", "start_date"), F.datediff("end_date", "peak.date")
    span = F.datediff("end_date", "start_date") + 1
    return out.select(
        *own, "start_date", "end_date", F.col("peak.date").alias("peak_date"), span.alias("duration_calendar_days"), "duration_observed_days", "exceedance_days", "interruption_days", "mean_valid_coverage",
        "mean_intensity", "maximum_intensity", "minimum_intensity", "cumulative_intensity", "intensity_standard_deviation", "p90_intensity",
        F.col("peak.value").alias("peak_value"), F.col("peak.threshold").alias("peak_threshold"), F.col("peak.intensity").alias("peak_exceedance"),
        F.when(rise > 0, (F.col("maximum_intensity") - F.col("first_intensity")) / rise).alias("onset_rate"), F.when(fall > 0, (F.col("maximum_intensity") - F.col("last_intensity")) / fall).alias("decline_rate"),
        rise.alias("time_to_peak_days"), fall.alias("time_from_peak_to_end_days"), F.when(several, F.col("up")).alias("maximum_daily_intensification"), F.when(several, F.col("down")).alias("maximum_daily_relaxation"),
        F.when(several, F.col("turns")).alias("number_of_turning_points"), "number_of_observed_interruptions", (F.col("mean_intensity") * span).alias("mean_intensity_times_duration"),
        C.severity(F.col("maximum_intensity"), bands).alias("severity_class"),
    )


def event_summary(flags: DataFrame, keys: list[str] = []) -> DataFrame:
    """Days per status, events and discontinuities of each series."""
    return flags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), *[F.count_if(F.col("status") == s).alias(f"{s}_days") for s in ("valid", "warning", "not_calculated")],
        F.coalesce(F.max("event"), F.lit(0)).alias("events"), F.count_if(F.col("event").isNotNull()).alias("event_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
