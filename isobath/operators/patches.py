"""Threshold patches of gridded cells: connected components per date, their metrics and daily summary.

Labelling runs per tile of a date's grid, on the cells above the threshold only; labels that touch over a
tile's border are merged as components of a graph, so neither a patch nor a grid has to fit a
task.  Everything else is aggregation by (date, patch).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.functions import statistics as S
from isobath.operators.graph import components
from isobath.sources.staging import stage

ROOK = ((-1, 0), (1, 0), (0, -1), (0, 1))
QUEEN = (*ROOK, (-1, -1), (-1, 1), (1, -1), (1, 1))
#: Rows and columns of a tile.
TILE = 512


@dataclass(frozen=True)
class PatchRule:
    threshold: float = 2.0
    direction: str = "above"
    inclusive: bool = True
    connectivity: str = "queen"
    minimum_cells: int = 4
    minimum_area_km2: float = 0.0
    drop_boundary_only: bool = False
    step: float = 1.0
    source_variable: str = "anomaly"
    threshold_type: str = "fixed"

    def __post_init__(self) -> None:
        if self.connectivity not in ("rook", "queen") or self.minimum_cells < 1 or self.step <= 0:
            raise ValueError("connectivity is rook or queen; sizes are positive")

    def description(self) -> str:
        sign = {("above", True): ">=", ("above", False): ">", ("below", True): "<=", ("below", False): "<"}[self.direction, self.inclusive]
        return f"{self.source_variable} {sign} {self.threshold:g} ({self.threshold_type})"


def neighbours(kind: str) -> tuple[tuple[int, int], ...]:
    return QUEEN if kind == "queen" else ROOK


def adjacency(cells: DataFrame, kind: str = "rook") -> DataFrame:
    """Directed neighbour pairs of the grid's cells: ``row, col, row_to, col_to``."""
    axis = cells.select("row", "col").distinct()
    offsets = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in neighbours(kind)]))
    pairs = axis.withColumn("o", offsets).select("row", "col", (F.col("row") + F.col("o.r")).alias("row_to"), (F.col("col") + F.col("o.c")).alias("col_to"))
    return pairs.join(axis.select(F.col("row").alias("row_to"), F.col("col").alias("col_to")), ["row_to", "col_to"], "left_semi")


def least_labels(row: np.ndarray, col: np.ndarray, kind: str) -> np.ndarray:
    """Per cell the least position (in scan order) of its component; cells are in scan order."""
    width = int(col.max()) + 3
    key = (row.astype(np.int64) + 1) * width + col + 1
    parent = np.arange(len(key))
    pairs = []
    for r, c in neighbours(kind):
        other = key + r * width + c
        at = np.minimum(np.searchsorted(key, other), len(key) - 1)
        hit = np.flatnonzero((key[at] == other) & (at < np.arange(len(key))))
        pairs.append(np.stack([hit, at[hit]]))
    a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        parent = parent[parent]
        if np.array_equal(parent, before):
            return parent


def labelled(mask_cells: DataFrame, kind: str, keys: list[str] = ["date"], tile: int = TILE) -> DataFrame:
    """``keys, row, col, label``: components of the given cells, named by the place of their first cell in scan order."""
    at = [F.floor(F.col(c) / tile).cast("int").alias(f"{c}_tile") for c in ("row", "col")]
    cells = mask_cells.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *at)

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "col"]).reset_index(drop=True)
        row, col = frame["row"].to_numpy().astype("int64"), frame["col"].to_numpy().astype("int64")
        first = least_labels(row - row.min(), col - col.min(), kind)
        return frame.assign(label=row[first] << 32 | col[first])

    fields = ", ".join(f"{n} {t}" for n, t in cells.dtypes)
    own = stage(cells.groupBy(*keys, "row_tile", "col_tile").applyInPandas(label, f"{fields}, label long"), "tiles")
    found = own.select(*keys, "row", "col", "label")
    edges = stage(borders(own, kind, keys, tile), "borders")
    if edges.isEmpty():
        return found
    merged = components(edges).select("node.*", F.col("component.label").alias("least"))
    return found.join(merged, [*keys, "label"], "left").select(*keys, "row", "col", F.coalesce("least", "label").alias("label"))


def borders(cells: DataFrame, kind: str, keys: list[str], tile: int) -> DataFrame:
    """``a, b``: labels (with their keys) of neighbouring cells of different tiles, once each; only cells on a border are looked at."""
    on_border = F.pmod("row", F.lit(tile)).isin(0, tile - 1) | F.pmod("col", F.lit(tile)).isin(0, tile - 1)
    edge = cells.where(on_border)
    forward = [o for o in neighbours(kind) if o > (0, 0)]
    to = edge.withColumn("o", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in forward])))
    to = to.select(*keys, (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), F.col("label").alias("a"), "row_tile", "col_tile")
    to = to.where((F.floor(F.col("row") / tile) != F.col("row_tile")) | (F.floor(F.col("col") / tile) != F.col("col_tile"))).drop("row_tile", "col_tile")
    met = to.join(edge.select(*keys, "row", "col", F.col("label").alias("b")), [*keys, "row", "col"])
    return met.select(F.struct(*keys, F.col("a").alias("label")).alias("a"), F.struct(*keys, F.col("b").alias("label")).alias("b")).distinct()


def detected(cells: DataFrame, rule: PatchRule) -> DataFrame:
    """Cells of kept patches with ``patch_id`` (1.. per date in scan order), area and exceedance.

    Too few cells, then too small an area, then contact with the frame alone rule a patch out.
    """
    area = C.cell_area_km2(F.col("lat"), rule.step, rule.step)
    above = C.exceeds(F.col("value"), F.lit(rule.threshold), rule.direction, rule.inclusive)
    mask = cells.where(F.col("value").isNotNull() & above)
    frame = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    found = labelled(mask, rule.connectivity).join(mask, ["date", "row", "col"]).withColumn("area", area).crossJoin(F.broadcast(frame))  # one row
    on_frame = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    sizes = found.groupBy("date", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("patch_area"), F.bool_and(on_frame).alias("edge_only"))
    kept = sizes.where((F.col("n") >= rule.minimum_cells) & (F.col("patch_area") >= rule.minimum_area_km2) & ~(F.col("edge_only") & F.lit(rule.drop_boundary_only)))
    kept = kept.select("date", "label", F.row_number().over(Window.partitionBy("date").orderBy("label")).alias("patch_id"))
    return found.join(kept, ["date", "label"]).select(
        "date", "patch_id", "row", "col", "lat", "lon", "value", "area", C.intensity(F.col("value"), F.lit(rule.threshold), rule.direction).alias("exceedance"),
        (F.col("row") == F.col("r1")).alias("north"), (F.col("row") == F.col("r0")).alias("south"), (F.col("col") == F.col("c1")).alias("east"), (F.col("col") == F.col("c0")).alias("west"),
    )


def exposed_edges(cells: DataFrame, rule: PatchRule) -> DataFrame:
    """Perimeter and edge cells per patch: sides without a neighbour in the same patch."""
    side = C.EARTH_RADIUS_KM * F.radians(F.lit(rule.step))
    top = F.least(F.col("lat") + rule.step / 2, F.lit(90.0))
    bottom = F.greatest(F.col("lat") - rule.step / 2, F.lit(-90.0))
    lengths = [side * F.cos(F.radians(bottom)), side * F.cos(F.radians(top)), C.EARTH_RADIUS_KM * F.radians(top - bottom), C.EARTH_RADIUS_KM * F.radians(top - bottom)]
    sides = F.explode(F.array(*[F.struct((F.col("row") + r).alias("row_to"), (F.col("col") + c).alias("col_to"), length.alias("length")) for (r, c), length in zip(ROOK, lengths, strict=True)]))
    out = cells.select("date", "patch_id", "row", "col", sides.alias("s")).select("date", "patch_id", "row", "col", "s.*")
    other = cells.select("date", "patch_id", F.col("row").alias("row_to"), F.col("col").alias("col_to"))
    bare = out.join(other, ["date", "patch_id", "row_to", "col_to"], "left_anti")
    return bare.groupBy("date", "patch_id", "row", "col").agg(F.sum("length").alias("length")).groupBy("date", "patch_id").agg(F.sum("length").alias("perimeter_km"), F.count(F.lit(1)).alias("edge_cells"))


def kilometres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular coordinates about an origin."""
    return C.EARTH_RADIUS_KM * F.radians(C.canonical_longitude(lon - lon0)) * F.cos(F.radians(lat0)), C.EARTH_RADIUS_KM * F.radians(lat - lat0)


def patch_table(cells: DataFrame, rule: PatchRule, found: DataFrame | None = None, *, climatology_method: str | None = None, data_mode: str = "unknown") -> DataFrame:
    """One row of 45 columns per patch."""
    found = detected(cells, rule) if found is None else found
    by, w = ["date", "patch_id"], F.col("area")
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    first = found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cell_count"), F.sum(w).alias("area_km2"), mean("lat").alias("centroid_latitude"), S.circular_mean_degrees(F.col("lon"), w).alias("centroid_longitude"),
        F.min("lat").alias("minimum_latitude"), F.max("lat").alias("maximum_latitude"), F.min("lon").alias("minimum_longitude"), F.max("lon").alias("maximum_longitude"),
        mean("value").alias("mean_source_value"), F.min("value").alias("minimum_source_value"), F.max("value").alias("maximum_source_value"),
        mean("exceedance").alias("mean_exceedance"), F.max("exceedance").alias("maximum_exceedance"), F.sum(F.col("exceedance") * w).alias("cumulative_exceedance_km2_units"),
        *[F.bool_or(s).alias(f"touches_{s}_boundary") for s in ("north", "south", "east", "west")],
    )
    quantiles = S.weighted_quantiles(found, by, "value", "area", {"median_source_value": 0.5, "p10": 0.1, "p90": 0.9})
    x, y = kilometres(F.col("lat"), F.col("lon"), F.col("centroid_latitude"), F.col("centroid_longitude"))
    placed = found.join(first.select(*by, "centroid_latitude", "centroid_longitude"), by).withColumn("x", x).withColumn("y", y)
    m = placed.groupBy(*by).agg(*[(F.sum(e * w) / F.sum(w)).alias(n) for n, e in {"x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}.items()])
    a, b, c = F.col("xx") - F.col("x") * F.col("x"), F.col("xy") - F.col("x") * F.col("y"), F.col("yy") - F.col("y") * F.col("y")
    half = F.sqrt((a - c) * (a - c) / 4 + b * b)
    shape = m.select(*by, F.greatest((a + c) / 2 + half, F.lit(0.0)).alias("major"), F.greatest((a + c) / 2 - half, F.lit(0.0)).alias("minor"), (F.pmod(F.round(F.degrees(F.atan2(2 * b, a - c)) / 2, 9) + 90.0, F.lit(180.0)) - 90.0).alias("turn"), F.sqrt(F.col("xx") + F.col("yy")).alias("centroid_dispersion_km"))
    region = cells.withColumn("area", C.cell_area_km2(F.col("lat"), rule.step, rule.step)).groupBy("date").agg(F.sum(F.when(F.col("value").isNotNull(), w)).alias("valid_area"), F.sum(w).alias("domain_area"))
    out = first.join(quantiles, by).join(shape, by).join(exposed_edges(found, rule), by).join(region, "date")
    eps = 1e-6
    flat, thin = F.col("major") <= eps, F.col("minor") <= eps
    reason = F.nullif(F.concat_ws("; ", F.when(flat, "Patch cell centres have no two-dimensional spatial variance"), F.when(~flat & thin, "Patch minor-axis variance is zero; elongation is undefined")), F.lit(""))
    return out.select(
        *by, F.lit(rule.source_variable).alias("source_variable"), F.lit(rule.threshold_type).alias("threshold_type"), F.lit(float(rule.threshold)).alias("threshold_value"), F.lit(rule.direction).alias("direction"), F.lit(rule.connectivity).alias("connectivity"),
        "cell_count", "area_km2", (F.col("area_km2") / F.col("valid_area")).alias("area_fraction_of_valid_region"), (F.col("area_km2") / F.sum("area_km2").over(Window.partitionBy("date"))).alias("area_fraction_of_threshold_total"),
        F.sqrt(F.col("area_km2") / np.pi).alias("equivalent_radius_km"), "centroid_latitude", "centroid_longitude", "minimum_latitude", "maximum_latitude", "minimum_longitude", "maximum_longitude",
        "mean_source_value", "median_source_value", "minimum_source_value", "maximum_source_value", "p10", "p90", "mean_exceedance", "maximum_exceedance", "cumulative_exceedance_km2_units",
        "perimeter_km", (4 * np.pi * F.col("area_km2") / (F.col("perimeter_km") * F.col("perimeter_km"))).alias("compactness"), (F.col("perimeter_km") / F.col("area_km2")).alias("perimeter_area_ratio"),
        F.when(~flat, F.col("turn")).alias("orientation_degrees"), F.when(~flat & ~thin, F.sqrt(F.col("major") / F.col("minor"))).alias("elongation"), (4 * F.sqrt("major")).alias("major_axis_length_km"), (4 * F.sqrt("minor")).alias("minor_axis_length_km"),
        "centroid_dispersion_km", (F.col("edge_cells") / F.col("cell_count")).alias("edge_cell_fraction"), *[f"touches_{s}_boundary" for s in ("north", "south", "east", "west")],
        (F.col("valid_area") / F.col("domain_area")).alias("valid_coverage"), F.lit(climatology_method).cast("string").alias("climatology_method"), F.lit(data_mode).alias("data_mode"),
        F.when(reason.isNotNull(), "warning").otherwise("valid").alias("status"), reason.alias("reason"),
    )


def daily_summary(cells: DataFrame, patches: DataFrame, rule: PatchRule) -> DataFrame:
    """One row of 20 columns per date, dates without patches too."""
    w = F.col("area")
    spine = cells.withColumn("area", C.cell_area_km2(F.col("lat"), rule.step, rule.step)).groupBy("date").agg(F.sum(F.when(F.col("value").isNotNull(), w)).alias("valid_area"), F.sum(w).alias("domain_area"))
    a = F.col("area_km2")
    totals = patches.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("total"), F.max(a).alias("largest"), F.avg(a).alias("mean_area"), F.percentile("area_km2", 0.5).alias("median_area"), F.stddev_pop(a).alias("sd_area"),
        (F.sum(F.col("mean_exceedance") * a) / F.sum(a)).alias("strength"), F.max("maximum_exceedance").alias("top"),
        (F.sum(F.col("centroid_latitude") * a) / F.sum(a)).alias("lat"), S.circular_mean_degrees(F.col("centroid_longitude"), a).alias("lon"), F.concat_ws("; ", F.array_sort(F.collect_set(F.when(F.col("status") == "warning", F.col("reason"))))).alias("why"),
    )
    x, y = kilometres(F.col("centroid_latitude"), F.col("centroid_longitude"), F.col("lat"), F.col("lon"))
    spread = patches.join(totals.select("date", "lat", "lon"), "date").groupBy("date").agg(F.sqrt(F.sum((x * x + y * y) * a) / F.sum(a)).alias("spread"))
    none = F.col("n").isNull()
    zero = lambda c: F.when(none, 0.0).otherwise(c)
    return spine.join(totals, "date", "left").join(spread, "date", "left").select(
        "date", F.coalesce("n", F.lit(0)).alias("patch_count"), zero(F.col("total")).alias("total_patch_area_km2"), zero(F.col("total") / F.col("valid_area")).alias("threshold_area_fraction"),
        zero(F.col("largest")).alias("largest_patch_area_km2"), zero(F.col("largest") / F.col("valid_area")).alias("largest_patch_fraction"), F.col("mean_area").alias("mean_patch_area_km2"),
        F.col("median_area").alias("median_patch_area_km2"), F.col("sd_area").alias("patch_area_standard_deviation_km2"), zero(F.col("n") / F.col("valid_area") * 10000.0).alias("patch_density_per_10000_km2"),
        (1.0 - F.col("largest") / F.col("total")).alias("fragmentation_index"), (F.col("largest") / F.col("total")).alias("dominant_patch_fraction"), F.col("strength").alias("area_weighted_mean_patch_intensity"),
        F.col("top").alias("maximum_patch_intensity"), F.col("lat").alias("area_weighted_centroid_latitude"), F.col("lon").alias("area_weighted_centroid_longitude"), F.col("spread").alias("patch_centroid_dispersion_km"),
        (F.col("valid_area") / F.col("domain_area")).alias("valid_coverage"), F.when(none, "not_calculated").when(F.col("why") != "", "warning").otherwise("valid").alias("status"),
        F.when(none, "No patches exceeded the configured criteria").otherwise(F.nullif("why", F.lit(""))).alias("reason"),
    )
