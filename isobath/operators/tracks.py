"""Links between patches of consecutive dates, their lineage, tracks and families.

Patches meet by equal cells on a date and the next available one: an equi-join whose rows follow the
overlap.  Only links that distance alone makes pair the patches of two dates, a bounded handful each.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.functions import statistics as S
from isobath.operators.graph import components, ranked
from isobath.sources.staging import stage


@dataclass(frozen=True)
class TrackRule:
    minimum_iou: float = 0.05
    minimum_predecessor_overlap: float = 0.15
    minimum_successor_overlap: float = 0.15
    minimum_link_score: float = 0.10
    maximum_centroid_distance_km: float = 500.0
    minimum_area_ratio: float = 0.2
    maximum_area_ratio: float = 5.0
    maximum_calendar_gap: int = 1
    distance_fallback: bool = False
    gap_bridging: bool = False
    maximum_bridge_gap: int = 3
    weights: tuple[float, float, float, float, float] = (0.35, 0.2, 0.2, 0.15, 0.1)

    def __post_init__(self) -> None:
        if abs(sum(self.weights) - 1) > 1e-9 or min(self.weights) < 0:
            raise ValueError("the weights of overlap, distance and similarity add up to 1")


def pair_metrics(cells: DataFrame, patches: DataFrame, rule: TrackRule) -> DataFrame:
    """Candidate pairs on consecutive available dates with overlap, score, acceptance and reasons."""
    dates = cells.select("date").distinct()
    following = dates.select("date", F.lead("date").over(Window.orderBy("date")).alias("next")).where("next IS NOT NULL")
    before = cells.select("date", "row", "col", F.col("patch_id").alias("p"), "area").join(F.broadcast(following), "date")  # a row per date
    after = cells.select(F.col("date").alias("next"), "row", "col", F.col("patch_id").alias("s"))
    shared = before.join(after, ["next", "row", "col"]).groupBy("date", "next", "p", "s").agg(F.count(F.lit(1)).alias("cells"), F.sum("area").alias("shared"))
    pairs = shared
    side = lambda d, k: patches.select(F.col("date").alias(d), F.col("patch_id").alias(k), *[F.col(c).alias(f"{k}_{n}") for c, n in (("area_km2", "area"), ("centroid_latitude", "lat"), ("centroid_longitude", "lon"), ("mean_source_value", "mean"), ("maximum_source_value", "max"))], (F.col("touches_north_boundary") | F.col("touches_south_boundary") | F.col("touches_east_boundary") | F.col("touches_west_boundary")).alias(f"{k}_edge"))
    left, right = side("date", "p"), side("next", "s")
    if rule.distance_fallback or rule.gap_bridging:
        every = left.select("date", "p").join(F.broadcast(following), "date").join(right.select("next", "s"), "next")
        pairs = every.join(shared, ["date", "next", "p", "s"], "left").fillna({"cells": 0, "shared": 0.0})
    rows = pairs.join(left, ["date", "p"]).join(right, ["next", "s"])
    union = F.col("p_area") + F.col("s_area") - F.col("shared")
    rows = rows.select("*", union.alias("union"), (F.col("shared") / union).alias("iou"), (F.col("shared") / F.col("p_area")).alias("po"), (F.col("shared") / F.col("s_area")).alias("so"), (F.col("s_area") / F.col("p_area")).alias("ratio"), C.haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("s_lat"), F.col("s_lon")).alias("distance"), F.datediff("next", "date").alias("elapsed"))
    near = F.greatest(F.lit(0.0), 1 - F.col("distance") / rule.maximum_centroid_distance_km)
    parts = (F.col("iou"), F.col("po"), F.col("so"), near, F.least(F.col("ratio"), 1 / F.col("ratio")))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum((w * p for w, p in zip(rule.weights, parts, strict=True)), F.lit(0.0))))
    overlap = (F.col("iou") >= rule.minimum_iou) | (F.col("po") >= rule.minimum_predecessor_overlap) | (F.col("so") >= rule.minimum_successor_overlap)
    able = (F.col("distance") <= rule.maximum_centroid_distance_km) & F.col("ratio").between(rule.minimum_area_ratio, rule.maximum_area_ratio)
    gap = F.col("elapsed") > rule.maximum_calendar_gap
    allowed = ~gap | (F.lit(rule.gap_bridging) & (F.col("elapsed") <= rule.maximum_bridge_gap) & able)
    fallback = able & ((F.lit(rule.distance_fallback) & (F.col("cells") == 0)) | gap)
    rows = rows.withColumn("score", score).withColumn("overlap", overlap).withColumn("fallback", fallback).withColumn("able", able).withColumn("allowed", allowed).withColumn("gap", gap)
    good = F.col("allowed") & (F.col("overlap") | F.col("fallback"))
    weak = good & (F.col("score") < rule.minimum_link_score)
    basis_on = F.lit(rule.distance_fallback) | (F.col("gap") & F.lit(rule.gap_bridging))
    reasons = F.concat_ws("; ", F.when(~F.col("allowed"), "Temporal gap exceeds the configured linking allowance"), F.when(~F.col("overlap") & ~F.col("fallback"), "Pair satisfies neither overlap nor enabled distance criteria"), F.when(weak, "Link score is below minimum_link_score"))
    return rows.select(
        F.col("date").alias("predecessor_date"), F.col("p").alias("predecessor_patch_id"), F.col("next").alias("successor_date"), F.col("s").alias("successor_patch_id"), F.col("elapsed").alias("elapsed_days"),
        F.col("cells").alias("intersection_cell_count"), F.col("shared").alias("intersection_area_km2"), F.col("union").alias("union_area_km2"), F.col("iou").alias("area_weighted_iou"),
        F.col("po").alias("predecessor_overlap_fraction"), F.col("so").alias("successor_overlap_fraction"), F.col("distance").alias("centroid_distance_km"), F.col("ratio").alias("area_ratio"), F.ln("ratio").alias("log_area_ratio"),
        (F.col("s_mean") - F.col("p_mean")).alias("mean_intensity_difference"), (F.col("s_max") - F.col("p_max")).alias("maximum_intensity_difference"), (F.col("p_edge") | F.col("s_edge")).alias("boundary_touching_status"),
        F.when(good & ~weak, "accepted").otherwise("rejected").alias("candidate_status"), F.nullif(reasons, F.lit("")).alias("rejection_reason"), F.col("score").alias("link_score"),
        F.when(F.col("overlap") & F.col("able") & basis_on, "both").when(F.col("overlap"), "overlap").when(F.col("fallback"), "distance_fallback").alias("link_basis"), F.col("gap").alias("crosses_temporal_gap"),
    )


def best_assignment(left: np.ndarray, right: np.ndarray, score: np.ndarray) -> list[int]:
    """Places of the given pairs that form the one-to-one choice of the largest total score; scores are positive.

    Shortest augmenting paths with potentials over the given pairs alone: memory follows the pairs.
    A left node may stay alone for a score of zero, which is an arc to an end of its own.
    """
    n = int(left.max()) + 1 if len(left) else 0
    m = int(right.max()) + 1 if len(right) else 0
    arcs: list[list[tuple[int, float, int]]] = [[(m + i, 0.0, -1)] for i in range(n)]
    for k, (i, j, x) in enumerate(zip(left.tolist(), right.tolist(), score.tolist(), strict=True)):
        arcs[i].append((j, -x, k))
    price, back = [0.0] * (m + n), [min(c for _, c, _ in a) for a in arcs]
    owner, chosen, mate = [-1] * (m + n), [-1] * (m + n), [-1] * n
    for start in range(n):
        least: dict[int, float] = {}
        way: dict[int, tuple[int, int]] = {}
        settled: list[tuple[int, float]] = []
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        i, base = start, 0.0
        while True:
            for j, cost, k in arcs[i]:
                if j not in done:
                    d = base + cost - back[i] - price[j]
                    if d < least.get(j, math.inf):
                        least[j], way[j] = d, (i, k)
                        heapq.heappush(heap, (d, j))
            while True:
                base, j = heapq.heappop(heap)
                if j not in done and base == least[j]:
                    break
            done.add(j)
            if owner[j] < 0:
                break
            settled.append((j, base))
            i = owner[j]
        back[start] += base
        for seen, d in settled:
            back[owner[seen]] += base - d
            price[seen] -= base - d
        while True:  # turn the path round
            i, k = way[j]
            owner[j], chosen[j], mate[i], j = i, k, j, mate[i]
            if i == start:
                break
    return sorted(k for k in chosen if k >= 0)


def links(cells: DataFrame, patches: DataFrame, rule: TrackRule) -> DataFrame:
    """Accepted pairs, those of the best one-to-one assignment of their dates marked as backbone.

    Scores are tied by overlap, distance and at last by order, all below the score's own precision.
    """
    accepted = pair_metrics(cells, patches, rule).where("candidate_status = 'accepted'")

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        p, i = np.unique(frame["predecessor_patch_id"], return_inverse=True)
        s, j = np.unique(frame["successor_patch_id"], return_inverse=True)
        tie = frame["area_weighted_iou"] * 1e-10 + frame["intersection_area_km2"].clip(upper=1e6) * 1e-18 + (1 - frame["centroid_distance_km"] / 20050.0).clip(lower=0) * 1e-12
        score = (frame["link_score"] + tie).to_numpy() + (len(p) - i) * (len(s) - j) * 1e-14
        chosen = set(best_assignment(i, j, score))
        return frame.assign(is_continuation_backbone=[k in chosen for k in range(len(frame))])

    fields = ", ".join(f"{n} {t}" for n, t in accepted.dtypes)
    return accepted.groupBy("predecessor_date", "successor_date").applyInPandas(assign, f"{fields}, is_continuation_backbone boolean")


def node_type(parents: Column, children: Column, split_child: Column, merge_parent: Column, plain: Column) -> Column:
    """The class of a node from its degrees and its neighbours'; the order of the rules is fixed."""
    split, merge = children >= 2, parents >= 2
    return (
        F.when((split | split_child) & (merge_parent | merge), "complex_branch").when(split, "split_parent").when(merge, "merge_child").when(split_child, "split_child").when(merge_parent, "merge_parent")
        .when((parents == 0) & (children == 0), "isolated_single_day").when(parents == 0, "appearance").when(children == 0, "termination").when(plain, "continuation").otherwise("complex_branch")
    )


def lineage(patches: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations with types, tracks and families, and edges with their relation."""
    e = stage(edges.select("*", C.node_id(F.col("predecessor_date"), F.col("predecessor_patch_id")).alias("a"), C.node_id(F.col("successor_date"), F.col("successor_patch_id")).alias("b")), "lineage")
    outs, ins = e.groupBy("a").agg(F.count(F.lit(1)).alias("outs")), e.groupBy("b").agg(F.count(F.lit(1)).alias("ins"))
    e = e.join(outs, "a").join(ins, "b")
    split, merge = F.col("outs") >= 2, F.col("ins") >= 2
    e = e.withColumn("lineage_relation", F.when(split & merge, "complex").when(split, "split").when(merge, "merge").otherwise("continuation"))
    nodes = patches.withColumn("node_id", C.node_id(F.col("date"), F.col("patch_id")))
    backbone = F.when(F.col("is_continuation_backbone"), F.col("a")), F.when(F.col("is_continuation_backbone"), F.col("b"))
    up = e.groupBy(F.col("b").alias("node_id")).agg(F.array_sort(F.collect_list("a")).alias("parent_node_ids"), F.max("outs").alias("most_outs"), F.max(backbone[0]).alias("continuation_backbone_parent"), F.bool_or("crosses_temporal_gap").alias("gap_in"))
    down = e.groupBy(F.col("a").alias("node_id")).agg(F.array_sort(F.collect_list("b")).alias("child_node_ids"), F.max("ins").alias("most_ins"), F.max(backbone[1]).alias("continuation_backbone_child"))
    none = F.array().cast("array<string>")
    rows = nodes.join(up, "node_id", "left").join(down, "node_id", "left").withColumn("parent_node_ids", F.coalesce("parent_node_ids", none)).withColumn("child_node_ids", F.coalesce("child_node_ids", none))
    parents, children = F.size("parent_node_ids"), F.size("child_node_ids")
    plain = (parents == 1) & (children == 1) & (F.col("most_outs") == 1) & (F.col("most_ins") == 1)
    rows = rows.withColumn("node_event_type", node_type(parents, children, F.coalesce(F.col("most_outs") >= 2, F.lit(False)), F.coalesce(F.col("most_ins") >= 2, F.lit(False)), F.coalesce(plain, F.lit(False))))
    chain = e.where(F.col("is_continuation_backbone") & (F.col("outs") == 1) & (F.col("ins") == 1))
    rows = stage(_numbered(_numbered(rows, chain, "track_id", "T"), e, "event_family_id", "F"), "observations")
    track = rows.select(F.col("node_id").alias("n"), F.col("track_id").alias("t"))
    of = lambda far, near, name: e.join(track, e[far] == track["n"]).groupBy(F.col(near).alias("node_id")).agg(F.array_sort(F.collect_set("t")).alias(name))
    rows = rows.join(of("a", "b", "parent_track_ids"), "node_id", "left").join(of("b", "a", "child_track_ids"), "node_id", "left")
    observations = rows.select(
        "node_id", "date", F.col("patch_id").alias("local_patch_id"), "track_id", "event_family_id", "node_event_type", "source_variable", "threshold_type", "direction", "area_km2", "centroid_latitude", "centroid_longitude",
        "mean_source_value", "maximum_source_value", "mean_exceedance", "maximum_exceedance", "parent_node_ids", "child_node_ids", F.coalesce("parent_track_ids", none).alias("parent_track_ids"), F.coalesce("child_track_ids", none).alias("child_track_ids"),
        parents.alias("predecessor_count"), children.alias("successor_count"), "continuation_backbone_parent", "continuation_backbone_child", F.coalesce("gap_in", F.lit(False)).alias("link_crossed_temporal_gap"),
        "valid_coverage", "climatology_method", "data_mode", "status", "reason", *[f"touches_{s}_boundary" for s in ("north", "south", "east", "west")],
    )
    out = e.select(
        F.col("a").alias("predecessor_node_id"), F.col("b").alias("successor_node_id"), "predecessor_date", "successor_date", "predecessor_patch_id", "successor_patch_id", "elapsed_days", "intersection_cell_count",
        "intersection_area_km2", "union_area_km2", "area_weighted_iou", "predecessor_overlap_fraction", "successor_overlap_fraction", "centroid_distance_km", "area_ratio", "link_score", "link_basis", "is_continuation_backbone",
        "lineage_relation", "crosses_temporal_gap", F.lit("valid").alias("status"), F.lit(None).cast("string").alias("reason"),
    )
    return observations, out


def _numbered(rows: DataFrame, edges: DataFrame, name: str, letter: str) -> DataFrame:
    """Rows with an id per component of ``edges``, numbered by the component's first node.

    Centroids order it to nine digits: beyond, they hang on the order of summation.
    """
    label = components(edges.select("a", "b")).withColumnRenamed("node", "node_id")
    rows = rows.join(label, "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))
    first = rows.groupBy("component").agg(F.min(F.struct("date", F.round("centroid_latitude", 9), F.round("centroid_longitude", 9), "patch_id")).alias("first"))
    numbers = ranked(first, ["first", "component"], "number").select("component", F.concat(F.lit(letter), F.lpad(F.col("number").cast("string"), 6, "0")).alias(name))
    return rows.join(numbers, "component").drop("component")


def lineage_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that break the lineage: unknown ends, repeats, or not forward in time (which rules out cycles)."""
    known = nodes.select("node_id")
    ends = [edges.join(known, edges[c] == known["node_id"], "left_anti").select("predecessor_node_id", "successor_node_id", F.lit(f"unknown {c}").alias("problem")) for c in ("predecessor_node_id", "successor_node_id")]
    twice = edges.groupBy("predecessor_node_id", "successor_node_id").count().where("count > 1").select("predecessor_node_id", "successor_node_id", F.lit("duplicate").alias("problem"))
    late = edges.where("successor_date <= predecessor_date").select("predecessor_node_id", "successor_node_id", F.lit("not forward in time").alias("problem"))
    return ends[0].unionByName(ends[1]).unionByName(twice).unionByName(late)


def movement(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: displacement, length, speeds, bearings and tortuosity of the centroids in order of time."""
    order = Window.partitionBy(*keys).orderBy("date")
    lat, lon = F.col("centroid_latitude"), F.col("centroid_longitude")
    was = [F.lag(c).over(order) for c in ("centroid_latitude", "centroid_longitude", "date")]
    steps = rows.select(*keys, "date", "centroid_latitude", "centroid_longitude", C.haversine_km(was[0], was[1], lat, lon).alias("km"), C.bearing_degrees(was[0], was[1], lat, lon).alias("bearing"), F.datediff("date", was[2]).alias("days"))
    ends = [F.min_by(F.struct("centroid_latitude", "centroid_longitude"), "date").alias("a"), F.max_by(F.struct("centroid_latitude", "centroid_longitude"), "date").alias("z")]
    out = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("km").alias("length"), F.max(F.col("km") / F.col("days")).alias("top"), F.sum("days").alias("span"), F.avg(F.sin(F.radians("bearing"))).alias("s"), F.avg(F.cos(F.radians("bearing"))).alias("c"), *ends)
    net = C.haversine_km(F.col("a.centroid_latitude"), F.col("a.centroid_longitude"), F.col("z.centroid_latitude"), F.col("z.centroid_longitude"))
    many = F.col("n") >= 2
    return out.select(
        *keys, F.when(many, net).otherwise(0.0).alias("net_displacement_km"), F.when(many, F.col("length")).otherwise(0.0).alias("trajectory_length_km"), F.when(F.col("span") > 0, F.col("length") / F.col("span")).alias("mean_speed_km_per_day"),
        F.col("top").alias("maximum_speed_km_per_day"), F.pmod(F.degrees(F.atan2("s", "c")) + 360.0, F.lit(360.0)).alias("mean_bearing_degrees"),
        F.when(many, C.bearing_degrees(F.col("a.centroid_latitude"), F.col("a.centroid_longitude"), F.col("z.centroid_latitude"), F.col("z.centroid_longitude"))).alias("net_bearing_degrees"),
        F.when(many & (net > 1e-12), F.col("length") / net).alias("trajectory_tortuosity"), F.col("a.centroid_latitude").alias("start_centroid_latitude"), F.col("a.centroid_longitude").alias("start_centroid_longitude"),
        F.col("z.centroid_latitude").alias("end_centroid_latitude"), F.col("z.centroid_longitude").alias("end_centroid_longitude"),
    )


_EDGES = ["touches_north_boundary", "touches_south_boundary", "touches_east_boundary", "touches_west_boundary"]


def track_metrics(observations: DataFrame) -> DataFrame:
    """One row of 50 columns per track."""
    by = ["track_id"]
    order = Window.partitionBy(*by).orderBy("date")
    days = F.datediff("date", F.lag("date").over(order))
    a = F.col("area_km2")
    rows = observations.withColumn("days", days).withColumn("change", (a - F.lag("area_km2").over(order)) / days)
    edge = F.col(_EDGES[0]) | F.col(_EDGES[1]) | F.col(_EDGES[2]) | F.col(_EDGES[3])
    up, down = F.col("change") > 0, F.col("change") < 0
    wide = rows.groupBy(*by).agg(
        F.first("event_family_id").alias("event_family_id"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("observed_days"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("duration_calendar_days"),
        F.count_if(F.col("days") > 1).alias("internal_gap_count"), F.min_by("node_event_type", "date").alias("start_event_type"), F.max_by("node_event_type", "date").alias("end_event_type"),
        F.avg(a).alias("mean_area_km2"), F.percentile("area_km2", 0.5).alias("median_area_km2"), F.max(a).alias("maximum_area_km2"), F.min(a).alias("minimum_area_km2"), F.stddev_pop(a).alias("area_standard_deviation_km2"), F.sum(a).alias("observed_area_days_km2_days"),
        (F.sum(F.col("mean_exceedance") * a) / F.sum(a)).alias("area_weighted_mean_exceedance"), F.max("maximum_exceedance").alias("maximum_exceedance"), (F.sum(F.col("mean_source_value") * a) / F.sum(a)).alias("mean_source_value"), F.max("maximum_source_value").alias("maximum_source_value"),
        F.sum(F.col("mean_exceedance") * a).alias("cumulative_severity"), F.avg("change").alias("mean_area_change_km2_per_day"), F.max(F.when(up, F.col("change"))).alias("maximum_expansion_rate_km2_per_day"), F.min(F.when(down, F.col("change"))).alias("maximum_contraction_rate_km2_per_day"),
        ((F.max_by("area_km2", "date") - F.min_by("area_km2", "date")) / F.min_by("area_km2", "date")).alias("relative_area_change"), F.count_if(up).alias("expansion_day_count"), F.count_if(down).alias("contraction_day_count"),
        *[F.bool_or(c).alias(c.replace("touches", "touched")) for c in _EDGES], F.count_if(edge).alias("boundary_contact_day_count"),
    )
    units = {"area_unit": "km2", "observed_area_days_unit": "km2 day", "exceedance_unit": "source-variable unit", "cumulative_severity_unit": "source-variable unit km2 day", "movement_unit": "km", "speed_unit": "km day-1"}
    reason = F.when(F.col("observed_days") == 1, "Movement and area-change rates require at least two observations").when(F.col("trajectory_tortuosity").isNull(), "Trajectory tortuosity is not calculated for zero net displacement")
    return wide.join(movement(observations, by), by).select("*", *[F.lit(v).alias(k) for k, v in units.items()], F.when(reason.isNotNull(), "warning").otherwise("valid").alias("status"), reason.alias("reason"))


def family_daily(observations: DataFrame) -> DataFrame:
    """Area and centroid of every family on each of its dates."""
    a = F.col("area_km2")
    return observations.groupBy("event_family_id", "date").agg(F.sum(a).alias("area_km2"), F.count(F.lit(1)).alias("patches"), (F.sum(F.col("centroid_latitude") * a) / F.sum(a)).alias("centroid_latitude"), S.circular_mean_degrees(F.col("centroid_longitude"), a).alias("centroid_longitude"))


def family_metrics(observations: DataFrame) -> DataFrame:
    """One row of 36 columns per family."""
    by, a = ["event_family_id"], F.col("area_km2")
    edge = F.col(_EDGES[0]) | F.col(_EDGES[1]) | F.col(_EDGES[2]) | F.col(_EDGES[3])
    daily = family_daily(observations)
    kind = lambda k, n: F.count_if(F.col("node_event_type") == k).alias(n)
    own = observations.groupBy(*by).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("duration_calendar_days"), F.count(F.lit(1)).alias("observed_patch_days"), F.countDistinct("track_id").alias("track_count"), F.countDistinct("node_id").alias("unique_patch_observation_count"),
        kind("split_parent", "split_count"), kind("merge_child", "merge_count"), kind("complex_branch", "complex_branch_count"), F.sum(a).alias("family_area_days_km2_days"), F.max(a).alias("maximum_patch_area_km2"),
        (F.sum(F.col("mean_exceedance") * a) / F.sum(a)).alias("area_weighted_mean_exceedance"), F.max("maximum_exceedance").alias("maximum_exceedance"), F.sum(F.col("mean_exceedance") * a).alias("cumulative_severity"),
        F.countDistinct(F.when(edge, F.col("date"))).alias("boundary_contact_day_count"), F.first("climatology_method", ignorenulls=True).alias("climatology_method"), F.first("data_mode", ignorenulls=True).alias("data_mode"),
    )
    days = daily.groupBy(*by).agg(F.max("patches").alias("maximum_simultaneous_patch_count"), F.avg(a).alias("mean_total_daily_area_km2"), F.max(a).alias("maximum_total_daily_area_km2"), F.count(F.lit(1)).alias("dates"))
    one = observations.select(*by, "date", "node_id", F.col("centroid_latitude").alias("y"), F.col("centroid_longitude").alias("x"))
    two = one.select(*by, "date", F.col("node_id").alias("n2"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    extent = one.join(two, [*by, "date"]).where("node_id < n2").groupBy(*by).agg(F.max(C.haversine_km(F.col("y"), F.col("x"), F.col("y2"), F.col("x2"))).alias("extent"))  # patches of one family and date
    moved = movement(daily, by).select(*by, *[f"{e}_centroid_{c}" for e in ("start", "end") for c in ("latitude", "longitude")], F.col("net_displacement_km").alias("family_net_displacement_km"), F.col("trajectory_length_km").alias("family_trajectory_length_km"), F.col("mean_speed_km_per_day").alias("mean_family_speed_km_per_day"))
    units = {"area_unit": "km2", "family_area_days_unit": "km2 day", "cumulative_severity_unit": "source-variable unit km2 day", "movement_unit": "km", "speed_unit": "km day-1"}
    short = F.col("dates") < 2
    out = own.join(days, by).join(moved, by).join(extent, by, "left")
    return out.select(*[c for c in out.columns if c not in ("extent", "dates")], F.coalesce("extent", F.lit(0.0)).alias("maximum_family_extent_km"), *[F.lit(v).alias(k) for k, v in units.items()], F.when(short, "warning").otherwise("valid").alias("status"), F.when(short, "Family movement rates require at least two observed dates").alias("reason"))
