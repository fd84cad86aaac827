"""Coarser grids, several domains and regional indices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.functions import statistics as S
from isobath.operators import climatology


@dataclass(frozen=True)
class Box:
    """A closed rectangle of latitudes and longitudes."""

    lat: tuple[float, float]
    lon: tuple[float, float]

    def __post_init__(self) -> None:
        if self.lat[0] >= self.lat[1] or self.lon[0] >= self.lon[1] or not -90 <= self.lat[0] <= self.lat[1] <= 90:
            raise ValueError("bounds are ordered, latitudes within the poles")

    def vertices(self) -> list[tuple[float, float]]:
        (s, n), (w, e) = self.lat, self.lon
        return [(w, s), (e, s), (e, n), (w, n), (w, s)]


#: Standard regions: id, label, latitudes, longitudes.  Fixed values.
REGIONS = (
    ("nino12", "Niño 1+2", (-10.0, 0.0), (-90.0, -80.0)),
    ("nino3", "Niño 3", (-5.0, 5.0), (-150.0, -90.0)),
    ("nino34", "Niño 3.4", (-5.0, 5.0), (-170.0, -120.0)),
)


def region_table(spark, regions: tuple = REGIONS) -> DataFrame:
    return spark.createDataFrame([(i, n, *a, *o) for i, n, a, o in regions], "region_id string, region_label string, south double, north double, west double, east double")


def region_by_alias(regions: DataFrame, aliases: DataFrame, alias: str) -> DataFrame:
    """The region an alias names, without regard to case."""
    return regions.join(aliases.where(F.lower("alias") == alias.lower()).select("region_id"), "region_id", "left_semi")


def regular_step(cells: DataFrame, axis: str, coordinate: str, tolerance: float = 1e-3) -> DataFrame:
    """The spacing of an axis, and whether it is the same between all neighbours."""
    points = cells.select(coordinate).distinct()
    steps = points.select((F.col(coordinate) - F.lag(coordinate).over(Window.orderBy(coordinate))).alias("step")).where("step IS NOT NULL")  # one row per grid line
    return steps.agg(F.percentile("step", 0.5).alias("step"), ((F.max("step") - F.min("step")) <= tolerance).alias("regular"))


def _extent(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("lat").alias("low_lat"), F.max("lat").alias("high_lat"), F.min("lon").alias("low_lon"), F.max("lon").alias("high_lon"))


def box_overlap(cells: DataFrame, box: Box) -> DataFrame:
    """One row, ``meets``: whether the grid's extent meets the rectangle; a grid without cells meets none."""
    (s, n), (w, e) = box.lat, box.lon
    meets = (F.col("high_lat") >= s) & (F.col("low_lat") <= n) & (F.col("high_lon") >= w) & (F.col("low_lon") <= e)
    return _extent(cells).select(F.coalesce(meets, F.lit(False)).alias("meets"))


def region_completeness(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """``region_id``, ``complete``: whether the grid reaches each side of the region to half a step."""
    steps = regular_step(cells, "row", "lat").select((F.coalesce("step", F.lit(0.0)) / 2 + 1e-9).alias("lat_slack"))
    steps = steps.crossJoin(regular_step(cells, "col", "lon").select((F.coalesce("step", F.lit(0.0)) / 2 + 1e-9).alias("lon_slack")))  # one row each
    rows = regions.crossJoin(F.broadcast(_extent(cells).crossJoin(steps)))  # one row
    lat = (F.col("low_lat") <= F.col("south") + F.col("lat_slack")) & (F.col("high_lat") >= F.col("north") - F.col("lat_slack"))
    lon = (F.col("low_lon") <= F.col("west") + F.col("lon_slack")) & (F.col("high_lon") >= F.col("east") - F.col("lon_slack"))
    return rows.select("region_id", F.coalesce(lat & lon, F.lit(False)).alias("complete"))


def complete_regions(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """The regions that the grid covers: those an index may be given for."""
    return regions.join(region_completeness(cells, regions).where("complete"), "region_id", "left_semi")


def block_means(cells: DataFrame, factor: int, *, minimum_fraction: float = 0.8) -> DataFrame:
    """Area-weighted means of ``factor`` x ``factor`` blocks, where enough of the block is valid; edge blocks are partial."""
    if factor < 1:
        raise ValueError("a finer grid can't be made from a coarser one")
    v, w = F.col("value"), C.latitude_weight(F.col("lat"))
    out = cells.withColumn("w", w).groupBy("date", F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), S.weighted_mean(v, F.col("w")).alias("mean"), S.coverage(v, F.col("w")).alias("valid_coverage"),
    )
    return out.select("date", "row", "col", "lat", "lon", F.when(F.col("valid_coverage") >= minimum_fraction, F.col("mean")).alias("value"), "valid_coverage")


def in_regions(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells with each region that holds them; regions are a handful of rectangles."""
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return cells.join(F.broadcast(regions), inside)


def regional_means(cells: DataFrame, regions: DataFrame, *, minimum_coverage: float = 0.8) -> DataFrame:
    v, w = F.col("value"), F.col("w")
    rows = in_regions(cells.withColumn("w", C.latitude_weight(F.col("lat"))), regions)
    out = rows.groupBy("date", "region_id", "region_label").agg(S.weighted_mean(v, w).alias("mean"), S.coverage(v, w).alias("valid_coverage"), F.count(v).alias("valid_cell_count"), F.count(F.lit(1)).alias("total_cell_count"))
    return out.select("date", "region_id", "region_label", F.when(F.col("valid_coverage") >= minimum_coverage, F.col("mean")).alias("mean_sst_c"), "valid_coverage", "valid_cell_count", "total_cell_count")


def regional_indices(cells: DataFrame, regions: DataFrame, regional_climatology: DataFrame | None = None, *, minimum_coverage: float = 0.8, source_domain: str = "pacific_context", source_mode: str = "unknown") -> DataFrame:
    """16 columns per date and region: the mean, and anomaly, score and P90 flag where a climatology fits."""
    rows = regional_means(cells, regions, minimum_coverage=minimum_coverage)
    if regional_climatology is None:
        clim = rows.select("region_id", F.lit(0).alias("doy"), *[F.lit(None).cast("double").alias(c) for c in ("clim_mean", "clim_std", "clim_p90")], F.lit(None).cast("string").alias("method")).limit(0)
    else:
        clim = regional_climatology.select("region_id", "doy", "clim_mean", "clim_std", "clim_p90", F.lit("daily").alias("method"))
    rows = rows.withColumn("doy", C.stable_day(F.col("date"))).join(clim, ["region_id", "doy"], "left")
    known = F.col("mean_sst_c").isNotNull() & F.col("clim_mean").isNotNull()
    anomaly = F.when(known, F.col("mean_sst_c") - F.col("clim_mean"))
    score = F.when(F.col("clim_std") > 0, anomaly / F.col("clim_std"))
    beyond = F.when(known, F.col("mean_sst_c") > F.col("clim_p90"))
    status = F.when(known & score.isNotNull() & beyond.isNotNull(), "calculated").when(known, "partial").otherwise("not_calculated_no_compatible_climatology")
    return rows.select(
        "date", "region_id", "region_label", "mean_sst_c", "valid_coverage", "valid_cell_count", "total_cell_count", F.lit(source_domain).alias("source_domain"), F.lit(source_mode).alias("source_mode"),
        F.when(known, F.col("clim_mean")).alias("climatological_mean_c"), anomaly.alias("anomaly_c"), score.alias("standardized_anomaly"), F.when(known, F.col("clim_p90")).alias("threshold_p90_c"), beyond.alias("exceeds_p90"),
        status.alias("anomaly_status"), F.when(known, F.col("method")).otherwise("not_available").alias("climatology_method"),
    )


def region_climatology(clim: DataFrame, regions: DataFrame, *, minimum_coverage: float = 0.8) -> DataFrame:
    """Regional means per stable day of a gridded climatology (with ``lat``, ``lon``), gated each by its own coverage."""
    rows = in_regions(clim.withColumn("w", C.latitude_weight(F.col("lat"))), regions)
    gated = lambda c: F.when(S.coverage(F.col(c), F.col("w")) >= minimum_coverage, S.weighted_mean(F.col(c), F.col("w")))
    return rows.groupBy("doy", "region_id", "region_label").agg(*[gated(c).alias(c) for c in ("clim_mean", "clim_std", "clim_p10", "clim_p90")], S.coverage(F.col("clim_mean"), F.col("w")).alias("valid_coverage"))


def regional_partials(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Sums per date and region that can be added up over tiles."""
    v, w = F.col("value"), F.col("w")
    return in_regions(cells.withColumn("w", C.latitude_weight(F.col("lat"))), regions).groupBy("date", "region_id").agg(F.sum(v * w).alias("weighted_sum"), F.coalesce(F.sum(S.weight_of(v, w)), F.lit(0.0)).alias("valid_weight"), F.sum(w).alias("total_weight"), F.count(v).alias("valid_cells"), F.count(F.lit(1)).alias("total_cells"))


def merged_partials(partials: DataFrame) -> DataFrame:
    out = partials.groupBy("date", "region_id").agg(*[F.sum(c).alias(c) for c in ("weighted_sum", "valid_weight", "total_weight", "valid_cells", "total_cells")])
    return out.select("date", "region_id", F.when(F.col("valid_weight") > 0, F.col("weighted_sum") / F.col("valid_weight")).alias("value"), (F.col("valid_weight") / F.col("total_weight")).alias("valid_coverage"), "valid_cells", "total_cells")


def regional_daily_climatology(series: DataFrame) -> DataFrame:
    """The 366-day climatology of regional series."""
    return climatology.daily_statistics(series, ["region_id"])


def domain_anomalies(cells: DataFrame, clim: DataFrame, *, minimum_coverage: float = 0.8, epsilon: float = 1e-12) -> DataFrame:
    """Anomaly, score and percentile flags, on dates whose plain share of valid cells suffices."""
    rows = cells.withColumn("valid_coverage", F.count("value").over(Window.partitionBy("date")) / F.count(F.lit(1)).over(Window.partitionBy("date")))
    rows = rows.withColumn("doy", C.stable_day(F.col("date"))).join(clim.select("doy", "row", "col", "clim_mean", "clim_std", "clim_p10", "clim_p90"), ["doy", "row", "col"], "left")
    good = F.col("valid_coverage") >= minimum_coverage
    v = F.col("value")
    anomaly = F.when(good, v - F.col("clim_mean"))
    finite = good & v.isNotNull() & F.col("clim_p10").isNotNull() & F.col("clim_p90").isNotNull()
    return rows.select("date", "row", "col", "value", "valid_coverage", anomaly.alias("sst_anomaly_c"), F.when(F.col("clim_std") > epsilon, anomaly / F.col("clim_std")).alias("sst_z_score"), F.when(finite, v < F.col("clim_p10")).alias("below_p10"), F.when(finite, v > F.col("clim_p90")).alias("exceeds_p90"), F.when(finite, "calculated").otherwise("not_calculated").alias("percentile_status"))


def compatibility(cells: DataFrame, clim: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: whether cells and climatology share their grid and calendar, the first problem found, and what is allowed."""
    a = cells.select("row", "col").distinct()
    b = clim.select("row", "col").distinct()
    lost = a.join(b, ["row", "col"], "left_anti").agg(F.count(F.lit(1)).alias("cells_without"))
    days = clim.agg(F.countDistinct("doy").alias("days"), F.bool_and(F.col("clim_std") >= 0).alias("sound"))
    status = F.when(F.col("cells_without") > 0, "incompatible_coordinates").when(F.col("days") != C.DAYS, "incompatible_calendar").when(~F.col("sound"), "invalid_deviation").otherwise("compatible")
    return lost.crossJoin(days).select(status.alias("status"), (status == "compatible").alias("anomaly_allowed"), (status == "compatible").alias("percentiles_allowed"))  # one row each
