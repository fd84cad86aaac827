"""Spatial features of daily fields: autocorrelation, texture, gradients, and representativeness classes."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.functions import statistics as S
from isobath.operators.patches import labelled, neighbours


def moran(cells: DataFrame, kind: str = "rook", *, row_standardized: bool = True, minimum_coverage: float = 0.8) -> DataFrame:
    """Moran's I per date over valid neighbours, weights standardised among those that are valid.

    Neighbours meet by an equi-join on shifted integers.  Null where coverage, cells or variance
    don't allow it.
    """
    rows = cells.withColumn("w", C.latitude_weight(F.col("lat")))
    stats = rows.groupBy("date").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.sum(F.when(F.col("value").isNotNull(), F.col("w")) / 1).alias("valid"), F.sum("w").alias("total"))
    z = rows.where("value IS NOT NULL").join(stats.select("date", "mean"), "date").select("date", "row", "col", (F.col("value") - F.col("mean")).alias("z"))
    offsets = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in neighbours(kind)]))
    out = z.withColumn("o", offsets).select("date", "row", "col", "z", (F.col("row") + F.col("o.r")).alias("r2"), (F.col("col") + F.col("o.c")).alias("c2"))
    pairs = out.join(z.select("date", F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("z").alias("z2")), ["date", "r2", "c2"])
    own = pairs.groupBy("date", "row", "col").agg(F.count(F.lit(1)).alias("k"), F.sum("z2").alias("around"), F.first("z").alias("z"))
    weight = F.lit(1.0) / F.col("k") if row_standardized else F.lit(1.0)
    sums = own.groupBy("date").agg(F.sum(weight * F.col("k")).alias("s0"), F.sum(weight * F.col("z") * F.col("around")).alias("cross"))
    spread = z.groupBy("date").agg(F.sum(F.col("z") * F.col("z")).alias("square"))
    fits = (F.col("valid") / F.col("total") >= minimum_coverage) & (F.col("n") >= 3) & (F.col("square") > 0)
    value = F.when(fits, F.col("n") / F.col("s0") * F.col("cross") / F.col("square"))
    return stats.join(sums, "date", "left").join(spread, "date", "left").select("date", value.alias(f"moran_i_{kind}"), "n", (F.col("valid") / F.col("total")).alias("coverage"))


def local_deviation(cells: DataFrame, window: int = 3) -> DataFrame:
    """Cells with ``local_sd``, the population deviation of the valid cells around each, two at least."""
    half = window // 2
    offsets = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-half, half + 1) for c in range(-half, half + 1)]))
    sent = cells.where("value IS NOT NULL").withColumn("o", offsets).select("date", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), F.col("value").alias("v"))
    around = sent.groupBy("date", "row", "col").agg(F.when(F.count("v") >= 2, F.stddev_pop("v")).alias("local_sd"))
    return cells.join(around, ["date", "row", "col"], "left")


def thermal_gradient(cells: DataFrame) -> DataFrame:
    """Cells with ``gradient``, the magnitude per degree: central differences inside, one-sided at the frame.

    Cells beside a missing one have none.  The grid must be full: missing cells are null rows.
    """

    def slope(along: str, across: str, coordinate: str) -> Column:
        line = Window.partitionBy("date", across).orderBy(along)
        before, after = F.lag("value").over(line), F.lead("value").over(line)
        low, high = F.lag(coordinate).over(line), F.lead(coordinate).over(line)
        v, x = F.col("value"), F.col(coordinate)
        return F.when(low.isNull(), (after - v) / (high - x)).when(high.isNull(), (v - before) / (x - low)).otherwise((after - before) / (high - low))

    rows = cells.withColumn("d_lat", slope("row", "col", "lat")).withColumn("d_lon", slope("col", "row", "lon"))
    return rows.withColumn("gradient", F.when(F.col("value").isNotNull(), F.sqrt(F.col("d_lat") * F.col("d_lat") + F.col("d_lon") * F.col("d_lon"))))


def patch_features(cells: DataFrame, threshold: float, kind: str = "queen", minimum_cells: int = 4) -> DataFrame:
    """Per date: count, areas, density, fragmentation, edge fraction, dispersion and axes of all kept patches."""
    rows = cells.withColumn("w", C.latitude_weight(F.col("lat")))
    mask = rows.where(F.col("value") > threshold)
    found = labelled(mask, kind).join(mask, ["date", "row", "col"])
    size = Window.partitionBy("date", "label")
    kept = found.withColumn("n", F.count(F.lit(1)).over(size)).where(F.col("n") >= minimum_cells)
    areas = kept.groupBy("date", "label").agg(F.sum("w").alias("a"))
    total = areas.groupBy("date").agg(F.count(F.lit(1)).alias("patch_count"), F.sum("a").alias("total_threshold_area"), F.max("a").alias("largest_patch_area"), F.avg("a").alias("mean_patch_area"), F.stddev_pop("a").alias("patch_area_standard_deviation"), (1 - F.sum(F.col("a") * F.col("a")) / (F.sum("a") * F.sum("a"))).alias("fragmentation_index"))
    offsets = neighbours(kind)
    out = kept.withColumn("o", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets]))).select("date", "row", "col", (F.col("row") + F.col("o.r")).alias("r2"), (F.col("col") + F.col("o.c")).alias("c2"))
    inner = out.join(kept.select("date", F.col("row").alias("r2"), F.col("col").alias("c2")), ["date", "r2", "c2"]).groupBy("date", "row", "col").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(offsets)).groupBy("date").agg(F.count(F.lit(1)).alias("inner"))
    m = kept.groupBy("date").agg(F.count(F.lit(1)).alias("cells"), *[(F.sum(e * F.col("w")) / F.sum("w")).alias(n) for n, e in {"x": F.col("lon"), "y": F.col("lat"), "xx": F.col("lon") * F.col("lon"), "yy": F.col("lat") * F.col("lat"), "xy": F.col("lon") * F.col("lat")}.items()])
    a, b, c = F.col("xx") - F.col("x") * F.col("x"), F.col("xy") - F.col("x") * F.col("y"), F.col("yy") - F.col("y") * F.col("y")
    half = F.sqrt((a - c) * (a - c) / 4 + b * b)
    major, minor = (a + c) / 2 + half, (a + c) / 2 - half
    valid = rows.groupBy("date").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("w"))).alias("valid_area"))
    every = valid.join(total, "date", "left").join(inner, "date", "left").join(m, "date", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0)).alias(n)
    return every.select(
        "date", F.coalesce("patch_count", F.lit(0)).alias("patch_count"), zero("total_threshold_area"), zero("largest_patch_area"), (F.col("largest_patch_area") / F.col("total_threshold_area")).alias("largest_patch_fraction"),
        (F.coalesce("patch_count", F.lit(0)) / F.col("valid_area")).alias("patch_density"), zero("mean_patch_area"), zero("patch_area_standard_deviation"), zero("fragmentation_index"),
        (1 - F.coalesce("inner", F.lit(0)) / F.col("cells")).alias("edge_cell_fraction"), F.sqrt(a + c).alias("centroid_dispersion"),
        F.when(major > 1e-9, F.pmod(F.round(F.degrees(F.atan2(2 * b, a - c)) / 2, 9) + 90.0, F.lit(180.0)) - 90.0).alias("orientation"), F.when(minor > 1e-9, F.sqrt(major / minor)).alias("elongation"),
    )


def threshold_features(cells: DataFrame, threshold: float) -> DataFrame:
    """Area above, mean excess, and centroid and dispersion weighted by the excess, per date."""
    v, w = F.col("value"), C.latitude_weight(F.col("lat"))
    rows = cells.withColumn("w", w).withColumn("excess", F.when(v > threshold, v - threshold).otherwise(0.0))
    e = F.col("excess") * F.col("w")
    total = F.sum(e)
    first = rows.groupBy("date").agg(
        S.percent_area(v, F.col("w"), v > threshold).alias("area_over_threshold"), (total / F.sum(S.weight_of(v, F.col("w")))).alias("weighted_excess_above_threshold"),
        F.when(total > 0, F.sum(e * F.col("lat")) / total).alias("centroid_latitude"), F.when(total > 0, F.sum(e * F.col("lon")) / total).alias("centroid_longitude"),
    )
    apart = (F.col("lat") - F.col("centroid_latitude")) * (F.col("lat") - F.col("centroid_latitude")) + (F.col("lon") - F.col("centroid_longitude")) * (F.col("lon") - F.col("centroid_longitude"))
    spread = rows.join(first.select("date", "centroid_latitude", "centroid_longitude"), "date").groupBy("date").agg(F.when(total > 0, F.sqrt(F.sum(e * apart) / total)).alias("centroid_dispersion"))
    return first.join(spread, "date")


@dataclass(frozen=True)
class ClassRule:
    """Limits of the classes; a fixed set of names."""

    minimum_coverage: float = 0.8
    strong_signal_c: float = 1.0
    weak_signal_c: float = 0.3
    neutral_band_c: float = 0.1
    coherent_sign_fraction: float = 0.7
    heterogeneous_sd_c: float = 1.0
    minimum_signal_heterogeneity_ratio: float = 1.0
    coexistence_fraction: float = 0.25
    dominant_patch_fraction: float = 0.5
    patch_density_threshold: float = 0.01
    epsilon: float = 1e-9

    def __post_init__(self) -> None:
        if min(asdict(self).values()) < 0:
            raise ValueError("limits aren't negative")


def class_inputs(cells: DataFrame, rule: ClassRule, kind: str = "queen", minimum_cells: int = 4) -> DataFrame:
    """The representativeness inputs of each date's anomalies (``value``)."""
    v, w = F.col("value"), F.col("w")
    band = rule.neutral_band_c
    rows = cells.withColumn("w", C.latitude_weight(F.col("lat")))
    share = lambda condition: F.sum(F.when(condition, S.weight_of(v, w)).otherwise(0.0)) / F.sum(S.weight_of(v, w))
    sign = F.when(v > band, 1.0).when(v < -band, -1.0).otherwise(0.0)
    first = rows.groupBy("date").agg(
        S.coverage(v, w).alias("valid_coverage"), S.weighted_mean(v, w).alias("weighted_mean_anomaly"), share(v > band).alias("positive_fraction"), share(v < -band).alias("negative_fraction"), share((v <= band) & (v >= -band)).alias("neutral_fraction"),
        F.abs(F.sum(sign * S.weight_of(v, w)) / F.sum(S.weight_of(v, w))).alias("sign_coherence"), S.weighted_mean(F.abs(v), w).alias("absolute"), share(v >= rule.strong_signal_c).alias("warm_area_fraction"), share(v <= -rule.strong_signal_c).alias("cold_area_fraction"),
    )
    quantiles = S.weighted_quantiles(rows, ["date"], "value", "w", {"weighted_median_anomaly": 0.5, "p25": 0.25, "p75": 0.75})
    sd = rows.join(first.select("date", "weighted_mean_anomaly"), "date").groupBy("date").agg(S.weighted_deviation(v, w, F.col("weighted_mean_anomaly")).alias("spatial_standard_deviation"))
    # patches of either sign apart
    signed = rows.where((v > band) | (v < -band)).withColumn("sign", (v > 0).cast("int"))
    found = labelled(signed, kind, ["date", "sign"]).join(signed.select("date", "row", "col", "w"), ["date", "row", "col"])
    areas = found.groupBy("date", "sign", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("a")).where(F.col("n") >= minimum_cells)
    patches = areas.groupBy("date").agg((F.max("a") / F.sum("a")).alias("dominant_patch_fraction"), F.count(F.lit(1)).alias("patches"))
    valid = rows.groupBy("date").agg(F.sum(S.weight_of(v, w)).alias("area"))
    all_ = first.join(quantiles, "date", "left").join(sd, "date").join(patches, "date", "left").join(valid, "date")
    mean, iqr = F.col("weighted_mean_anomaly"), F.col("p75") - F.col("p25")
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return all_.select(
        "date", "valid_coverage", "weighted_mean_anomaly", "weighted_median_anomaly", "spatial_standard_deviation", iqr.alias("weighted_iqr"), "positive_fraction", "negative_fraction", "neutral_fraction", "sign_coherence",
        (F.abs(mean) / (F.col("spatial_standard_deviation") + rule.epsilon)).alias("signal_heterogeneity_ratio"), (F.abs(mean - F.col("weighted_median_anomaly")) / (iqr + rule.epsilon)).alias("mean_median_difference"),
        "dominant_patch_fraction", (F.coalesce("patches", F.lit(0)) / F.col("area")).alias("patch_density"), "warm_area_fraction", "cold_area_fraction",
        clip(2 * F.least("positive_fraction", "negative_fraction")).alias("coexistence_index"), F.when(F.col("absolute") > rule.epsilon, clip(1 - F.abs(mean) / F.col("absolute"))).otherwise(F.when(F.col("absolute").isNotNull(), 0.0)).alias("spatial_compensation_index"),
    )


def classified(inputs: DataFrame, rule: ClassRule) -> DataFrame:
    """The first rule in order that holds: its class, status and evidence in [0, 1]."""
    c, mean, sd, coherence, ratio = (F.col(x) for x in ("valid_coverage", "weighted_mean_anomaly", "spatial_standard_deviation", "sign_coherence", "signal_heterogeneity_ratio"))
    pos, neg, neutral, comp, dominant, density = (F.col(x) for x in ("positive_fraction", "negative_fraction", "neutral_fraction", "spatial_compensation_index", "dominant_patch_fraction", "patch_density"))
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    average = lambda *xs: sum((clip(x) for x in xs), F.lit(0.0)) / len(xs)
    m, t = F.abs(mean), rule
    weak = 1 - m / max(t.weak_signal_c, t.epsilon)
    missing = mean.isNull() | sd.isNull() | coherence.isNull() | ratio.isNull() | pos.isNull() | neg.isNull() | neutral.isNull() | comp.isNull()
    rules = [
        (c.isNull() | (c < t.minimum_coverage), "insufficient_coverage", "not_calculated", "coverage_below_minimum", F.coalesce(clip(1 - c / t.minimum_coverage), F.lit(0.0))),
        (missing, "unclassified", "not_calculated", "required_input_metric_missing", F.lit(0.0)),
        ((m >= t.strong_signal_c) & (coherence >= t.coherent_sign_fraction) & (sd < t.heterogeneous_sd_c) & (ratio >= t.minimum_signal_heterogeneity_ratio), "strong_coherent", "valid", "strong_signal_and_coherent_sign",
         average(m / t.strong_signal_c, coherence / t.coherent_sign_fraction, ratio / t.minimum_signal_heterogeneity_ratio, 1 - sd / t.heterogeneous_sd_c)),
        ((m >= t.strong_signal_c) & ((sd >= t.heterogeneous_sd_c) | (ratio < t.minimum_signal_heterogeneity_ratio)), "strong_heterogeneous", "valid", "strong_signal_with_high_heterogeneity",
         average(m / t.strong_signal_c, F.greatest(sd / t.heterogeneous_sd_c, t.minimum_signal_heterogeneity_ratio / (ratio + t.epsilon)))),
        ((m <= t.weak_signal_c) & (pos >= t.coexistence_fraction) & (neg >= t.coexistence_fraction), "compensated_mixed", "valid", "opposing_signs_with_compensated_mean", average(weak, pos / t.coexistence_fraction, neg / t.coexistence_fraction, comp)),
        (dominant.isNotNull() & (dominant <= t.dominant_patch_fraction) & (density >= t.patch_density_threshold) & (pos + neg >= t.coexistence_fraction), "patch_distributed", "valid", "distributed_non_neutral_patches",
         average(1 - dominant / max(t.dominant_patch_fraction, t.epsilon), density / t.patch_density_threshold, (pos + neg) / t.coexistence_fraction)),
        ((m <= t.weak_signal_c) & (neutral >= t.coherent_sign_fraction) & (sd < t.heterogeneous_sd_c), "weak_homogeneous", "valid", "weak_signal_and_neutral_homogeneity", average(weak, neutral / t.coherent_sign_fraction, 1 - sd / t.heterogeneous_sd_c)),
    ]
    answer = None
    for holds, name, status, rule_name, evidence in rules:
        own = F.struct(F.lit(name).alias("class"), F.lit(status).alias("status"), F.lit(rule_name).alias("triggered_rule"), evidence.alias("evidence_score"))
        answer = F.when(holds, own) if answer is None else answer.when(holds, own)
    last = F.struct(F.lit("unclassified").alias("class"), F.lit("not_calculated").alias("status"), F.lit("no_ordered_rule_satisfied").alias("triggered_rule"), F.lit(0.0).alias("evidence_score"))
    return inputs.withColumn("answer", answer.otherwise(last)).select("date", "answer.*", *[c for c in inputs.columns if c != "date"])
