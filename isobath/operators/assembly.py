"""Whole products out of the operators: contracts, loaders, builders and long spatial tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.functions import statistics as S
from isobath.operators import bank, climatology, patches, regional, spatial
from isobath.operators.graph import ranked
from isobath.sources import cells as cell_sources
from isobath.sources import sinks


@dataclass(frozen=True)
class DomainSpec:
    """A domain: its box, resolution and where its cube and climatology lie."""

    domain_id: str
    box: regional.Box
    resolution: float
    path: str
    climatology_path: str | None = None
    minimum_coverage: float = 0.8

    def __post_init__(self) -> None:
        if self.resolution <= 0 or not 0 < self.minimum_coverage <= 1:
            raise ValueError("resolution and coverage are positive")


def registry(specs: list[DomainSpec]) -> dict[str, DomainSpec]:
    """Specs by id; neither ids nor climatology paths may be shared."""
    paths = [s.climatology_path for s in specs if s.climatology_path]
    if len({s.domain_id for s in specs}) < len(specs) or len(set(paths)) < len(paths):
        raise ValueError("domains share an id or a climatology")
    return {s.domain_id: s for s in specs}


def load_domain(spark: SparkSession, spec: DomainSpec, factor: int = 1) -> DataFrame:
    """A domain's cells, on a coarser grid by ``factor``, with their provenance."""
    cells = cell_sources.indexed(cell_sources.read_cells(spark, spec.path, lat=spec.box.lat, lon=spec.box.lon))
    cells = regional.block_means(cells, factor) if factor > 1 else cells
    return cells.withColumn("domain_id", F.lit(spec.domain_id))


def load_domains(spark: SparkSession, specs: dict[str, DomainSpec], factors: dict[str, int] | None = None) -> dict[str, tuple[str, DataFrame | None]]:
    """Each domain's state and cells; one that can't be read leaves the others alone."""
    out = {}
    for name, spec in specs.items():
        state, _ = cell_sources.load_product(spark, spec.path, ["date", "lat", "lon"])
        out[name] = (state, load_domain(spark, spec, (factors or {}).get(name, 1)) if state == "available" else None)
    return out


def load_products(spark: SparkSession, paths: dict[str, tuple[str, list[str]]]) -> dict[str, tuple[str, DataFrame | None]]:
    """Products by name with their states, from (path, required columns)."""
    return {name: cell_sources.load_product(spark, path, required) for name, (path, required) in paths.items()}


def load_sources(spark: SparkSession, specs: dict[str, tuple[str, list[str], bool]]) -> dict[str, DataFrame]:
    """Products that are there, from (path, required columns, mandatory); a mandatory one that isn't is an error."""
    out = {}
    for name, (path, required, mandatory) in specs.items():
        state, df = cell_sources.load_product(spark, path, required)
        if state in ("available", "empty"):
            out[name] = df
        elif mandatory:
            raise FileNotFoundError(f"{name} at {path} is {state}")
    return out


def read_climatology(spark: SparkSession, path: str, *, daily: bool = True) -> DataFrame:
    """A stored climatology with the columns that its kind needs."""
    needed = {"row", "col", "clim_mean", "clim_std"} | ({"doy", "clim_p10", "clim_p90", "clim_median", "n"} if daily else {"month"})
    df = spark.read.parquet(path)
    if missing := needed - set(df.columns):
        raise ValueError(f"the climatology lacks {', '.join(sorted(missing))}")
    return df


def first_compatible(cells: DataFrame, candidates: list[DataFrame]) -> tuple[int, DataFrame] | None:
    """The first climatology that fits the cells' grid and calendar."""
    for k, clim in enumerate(candidates):
        if regional.compatibility(cells, clim).first()["anomaly_allowed"]:
            return k, clim
    return None


def build_climatology(cells: DataFrame, folder: str, manifest: dict[int, dict[str, object]] | None = None, **options: object) -> tuple[DataFrame, dict[int, dict[str, object]]]:
    """Yearly checkpoints, reused where they are valid, then the pooled statistics of all of them, checked."""
    years = [r[0] for r in cells.select(F.year("date").alias("y")).distinct().orderBy("y").collect()]  # a few dozen
    done = sinks.resumable(cells.sparkSession, {y: cells.where(F.year("date") == y) for y in years}, folder, manifest or {})
    stored = cells.sparkSession.read.schema(cells.schema).parquet(*[f"{folder}/year={y}" for y in years])
    clim = climatology.daily_statistics(stored, **options)
    broken = [r.asDict() for r in climatology.violations(clim).where("rule <> 'days_missing'").collect()]
    if broken:
        raise ValueError(f"the climatology breaks its rules: {broken}")
    return clim, done


def build_tiles(cells: DataFrame, target_cells: int, **options: object) -> DataFrame:
    """The climatology with the tile that each cell belongs to; tiles only name parts of one aggregation."""
    size = cells.agg(F.max("row") + 1, F.max("col") + 1).first()
    parts = climatology.tiles(size[0], size[1], target_cells)
    tile = F.coalesce(*[F.when((F.col("row") >= a) & (F.col("row") < b) & (F.col("col") >= c) & (F.col("col") < d), F.lit(k)) for k, (a, b, c, d) in enumerate(parts)])
    return climatology.daily_statistics(cells, **options).withColumn("tile", tile)


def tile_problems(tiled: DataFrame) -> DataFrame:
    """Cells that no tile or more than one holds."""
    return tiled.groupBy("row", "col").agg(F.countDistinct("tile").alias("tiles")).where(F.col("tiles") != 1)


def demo_climatology(spark: SparkSession, rows: int, columns: int, *, step: float = 1.0) -> DataFrame:
    """An analytic 366-day climatology: a yearly wave over a gradient."""
    axis = spark.range(rows).select(F.col("id").cast("int").alias("row")).crossJoin(F.broadcast(spark.range(columns).select(F.col("id").cast("int").alias("col"))))
    days = climatology.calendar(spark).select("doy")
    wave = F.sin(F.col("doy") * (2 * 3.141592653589793 / 366))
    mean = 25.0 + 0.1 * F.col("row") * step - 0.05 * F.col("col") * step + 2.0 * wave
    spread = 0.8 + 0.1 * F.cos(F.col("doy") * (2 * 3.141592653589793 / 366))
    return axis.crossJoin(F.broadcast(days)).select("row", "col", "doy", F.lit(30).alias("n"), mean.alias("clim_mean"), mean.alias("clim_median"), spread.alias("clim_std"), (mean - 1.2816 * spread).alias("clim_p10"), (mean + 1.2816 * spread).alias("clim_p90"))


def unwrapped_longitudes(axis: DataFrame) -> DataFrame:
    """``col``, ``lon`` with jumps beyond half a turn taken out along the axis; one row per grid line."""
    order = Window.orderBy("col")
    step = F.col("lon") - F.lag("lon").over(order)
    turn = F.coalesce(F.pmod(step + 180.0, F.lit(360.0)) - 180.0, F.lit(0.0))
    return axis.withColumn("__turn", turn).withColumn("lon", F.first("lon").over(order) + F.sum("__turn").over(order)).drop("__turn")


def cell_edges(axis: DataFrame, coordinate: str) -> DataFrame:
    """Edges of each grid line: midpoints, half a step beyond the ends, latitudes within the poles."""
    order = Window.orderBy(coordinate)
    x, before, after = F.col(coordinate), F.lag(coordinate).over(order), F.lead(coordinate).over(order)
    low = F.when(before.isNotNull(), (before + x) / 2).otherwise(x - (after - x) / 2)
    high = F.when(after.isNotNull(), (after + x) / 2).otherwise(x + (x - before) / 2)
    if coordinate == "lat":
        low, high = F.greatest(low, F.lit(-90.0)), F.least(high, F.lit(90.0))
    return axis.withColumn("edge_low", low).withColumn("edge_high", high)


def validated_field(cells: DataFrame, ocean: DataFrame | None = None, threshold: DataFrame | None = None) -> DataFrame:
    """Cells with ``valid``: in the ocean (``row, col``), with a value and a threshold (``row, col, threshold``)."""
    rows = cells.withColumn("value", C.finite(F.col("value")))
    if ocean is not None:
        rows = rows.join(ocean.select("row", "col", F.lit(True).alias("ocean")), ["row", "col"], "left")
    if threshold is not None:
        rows = rows.join(threshold.select("row", "col", "threshold"), ["row", "col"], "left")
    valid = F.col("value").isNotNull() & (F.coalesce("ocean", F.lit(False)) if ocean is not None else F.lit(True)) & (F.col("threshold").isNotNull() if threshold is not None else F.lit(True))
    return rows.withColumn("valid", valid)


def ocean_cells(cells: DataFrame) -> DataFrame:
    """Cells that have a value on any date."""
    return cells.where(F.col("value").isNotNull()).select("row", "col").distinct()


def tracking_problems(labels: DataFrame, table: DataFrame, *, tolerance: float = 1e-5) -> DataFrame:
    """Patches that only one of the label cells and the patch table has, or whose areas differ."""
    mine = labels.groupBy("date", "patch_id").agg(F.sum("area").alias("label_area"))
    both = mine.join(table.select("date", "patch_id", "area_km2"), ["date", "patch_id"], "full")
    apart = F.abs(F.col("label_area") - F.col("area_km2")) > tolerance + tolerance * F.abs("area_km2")
    problem = F.when(F.col("area_km2").isNull(), "not in the table").when(F.col("label_area").isNull(), "without cells").when(apart, "areas differ")
    return both.withColumn("problem", problem).where("problem IS NOT NULL")


def track_labels(labels: DataFrame, observations: DataFrame) -> DataFrame:
    """The label cells with numbers for their track and family; numbers follow the ids' order."""
    number = lambda c: ranked(observations.select(c).distinct(), [c], f"{c}_number")
    own = observations.select("date", F.col("local_patch_id").alias("patch_id"), "track_id", "event_family_id", "node_event_type")
    return labels.join(own, ["date", "patch_id"]).join(number("track_id"), "track_id").join(number("event_family_id"), "event_family_id")


def spatial_feature_table(cells: DataFrame, *, variable: str, unit: str = "1", threshold: float = 2.0, minimum_coverage: float = 0.8, kind: str = "queen", minimum_cells: int = 4, window: int = 3) -> DataFrame:
    """The long table of all spatial features of a variable per date, with status and reason."""
    own = cells.withColumn("variable", F.lit(variable))
    wide = bank.daily_features(own).select("date", "weighted_mean", "weighted_median", F.col("spatial_p10").alias("weighted_p10"), F.col("spatial_p25").alias("weighted_p25"), F.col("spatial_p75").alias("weighted_p75"), F.col("spatial_p90").alias("weighted_p90"), (F.col("weighted_standard_deviation") * F.col("weighted_standard_deviation")).alias("weighted_variance"), "weighted_standard_deviation", "weighted_mad", "weighted_iqr", "latitudinal_gradient", "longitudinal_gradient", F.col("valid_observation_count").cast("long").alias("n_valid"), F.col("weighted_valid_coverage").alias("coverage"))
    w = C.latitude_weight(F.col("lat"))
    texture = spatial.local_deviation(cells, window).where("value IS NOT NULL").groupBy("date").agg(S.weighted_mean(F.col("local_sd"), w).alias("local_spatial_standard_deviation"))
    slope = spatial.thermal_gradient(cells).groupBy("date").agg(S.weighted_mean(F.col("gradient"), w).alias("thermal_gradient_magnitude"))
    moran = [spatial.moran(cells, k, minimum_coverage=minimum_coverage).select("date", f"moran_i_{k}") for k in ("rook", "queen")]
    shape = spatial.patch_features(cells, threshold, kind, minimum_cells).withColumnRenamed("centroid_dispersion", "patch_centroid_dispersion")
    for other in (spatial.threshold_features(cells, threshold), texture, slope, *moran, shape):
        wide = wide.join(other, "date", "left")
    families = {
        "coverage": ("coverage",), "state": ("weighted_mean", "weighted_median", "weighted_p10", "weighted_p25", "weighted_p75", "weighted_p90"), "heterogeneity": ("weighted_variance", "weighted_standard_deviation", "weighted_mad", "weighted_iqr"),
        "threshold": ("area_over_threshold", "weighted_excess_above_threshold"), "centroid": ("centroid_latitude", "centroid_longitude", "centroid_dispersion"), "gradient": ("latitudinal_gradient", "longitudinal_gradient", "thermal_gradient_magnitude"),
        "texture": ("local_spatial_standard_deviation",), "spatial_autocorrelation": ("moran_i_rook", "moran_i_queen"),
        "patch": ("patch_count", "total_threshold_area", "largest_patch_area", "largest_patch_fraction", "patch_density", "mean_patch_area", "patch_area_standard_deviation", "fragmentation_index", "edge_cell_fraction", "patch_centroid_dispersion", "orientation", "elongation"),
    }
    low = F.col("coverage").isNull() | (F.col("coverage") < minimum_coverage)
    reason = F.format_string(f"Valid coverage %.3f is below {minimum_coverage:.3f}", F.coalesce("coverage", F.lit(0.0)))
    missing = {"centroid": f"No cells exceed threshold {threshold:g}", "patch": "No retained cells exceed the threshold", "gradient": "Gradient requires at least two distinct coordinates"}
    entries = []
    for family, names in families.items():
        for name in names:
            value = F.col(name).cast("double") if family == "coverage" else F.when(~low, F.col(name).cast("double"))
            why = F.when(low & F.lit(family != "coverage"), reason).when(value.isNull(), missing.get(family, "The value is undefined"))
            entries.append(F.struct(F.lit(family).alias("family"), F.lit("valid_coverage" if name == "coverage" else name).alias("metric"), value.alias("value"), F.lit(_feature_unit(family, name, unit)).alias("unit"), F.when(value.isNull(), "not_calculated").otherwise("valid").alias("status"), why.alias("reason")))
    long = wide.select("date", "n_valid", "coverage", F.explode(F.array(*entries)).alias("e"))
    return long.select("date", F.lit(variable).alias("variable"), "e.family", "e.metric", "e.value", "e.unit", "e.status", "e.reason", F.col("n_valid").alias("n_observations"), F.col("coverage").alias("valid_coverage"), F.lit(threshold).alias("threshold"), F.lit(kind).alias("connectivity"))


def _feature_unit(family: str, name: str, unit: str) -> str:
    if family == "gradient":
        return f"{unit} per degree"
    if name == "weighted_variance":
        return f"{unit} squared"
    special = {"area_over_threshold": "%", "centroid_latitude": "degrees_north", "centroid_longitude": "degrees_east", "centroid_dispersion": "degrees", "patch_centroid_dispersion": "degrees", "orientation": "degrees", "patch_count": "count", "patch_density": "per_weighted_area"}
    if name in special:
        return special[name]
    if family in ("state", "heterogeneity", "threshold", "texture"):
        return unit
    return "weighted_area" if name.endswith("_area") or "area_" in name else "1"


def daily_patch_products(cells: DataFrame, rule: patches.PatchRule) -> dict[str, DataFrame]:
    """Labels, patch table and daily summary of one rule."""
    found = patches.detected(cells, rule)
    table = patches.patch_table(cells, rule, found)
    return {"labels": found, "patches": table, "daily_summary": patches.daily_summary(cells, table, rule)}


def per_domain(results: dict[str, tuple[str, DataFrame | None]], build: Callable[[str, DataFrame], DataFrame]) -> dict[str, tuple[str, DataFrame | None]]:
    """``build`` over every domain that is available; the others keep their state."""
    return {k: (state, build(k, df) if df is not None else None) for k, (state, df) in results.items()}


def json_records(df: DataFrame) -> DataFrame:
    """Each row as strict JSON text."""
    clean = sinks.strict(df)
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("json"))


def stable_table(df: DataFrame, columns: list[str], rows: int, order: list[str] | Column) -> DataFrame:
    """The first rows in a fixed order, with those columns that exist."""
    return df.select(*[c for c in columns if c in df.columns]).orderBy(order).limit(rows)
