"""Queries of patches, tracks, spatial features and representativeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.operators import assembly, daily, patches, spatial, tracks
from isobath.plans.common import quantile_sql, report, rounded
from isobath.sources.driver_tables import FULL_SQL, full_grid, grid_cells, grid_sql
from isobath.sources.staging import stage

RULE = patches.PatchRule(threshold=30.0, connectivity="rook", minimum_cells=3)
LINKS = tracks.TrackRule()
GRID = grid_sql()
_AREA = "6371.0088 * 6371.0088 * abs(sin(radians(least(lat + 0.5, 90))) - sin(radians(greatest(lat - 0.5, -90)))) * radians(1.0)"
_KEY = "(row * 1000 + col)"
#: Labels by propagation of the least scan position over rook neighbours of cells above the threshold.
FOUND = f"""mask AS (SELECT *, {_KEY} AS k, {_AREA} AS area FROM cells WHERE value >= 30),
nb AS (SELECT a.date, a.k, b.k AS k2 FROM mask a JOIN mask b ON a.date = b.date AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
reach AS (SELECT date, k, k AS m FROM mask UNION SELECT n.date, n.k2, r.m FROM reach r JOIN nb n ON n.date = r.date AND n.k = r.k WHERE r.m < n.k2),
lab AS (SELECT date, k, min(m) AS label FROM reach GROUP BY ALL),
kept AS (SELECT date, label, row_number() OVER (PARTITION BY date ORDER BY label) AS patch_id FROM (SELECT date, label, count(*) AS n FROM lab GROUP BY ALL) WHERE n >= 3),
found AS (SELECT m.*, patch_id, value - 30 AS exceedance FROM mask m JOIN lab USING (date, k) JOIN kept USING (date, label))"""
WITH = f"WITH RECURSIVE {GRID}, {FOUND}"


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells and labelled cells; the latter are staged, for all that follows reads them several times."""
    cells = grid_cells(spark, sf_dir)
    return cells, stage(patches.detected(cells, RULE), "found")


def patch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_found(spark, sf_dir)[1].select("date", "row", "col", "patch_id", "area"))


_CELL = "CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col"
PATCH_LABELS = rounded(f"{WITH} SELECT * FROM found", "area", f"date, {_CELL}, patch_id")
_PATCH_COLUMNS = ["cell_count", "area_km2", "centroid_latitude", "centroid_longitude", "mean_source_value", "median_source_value", "minimum_source_value", "maximum_source_value", "p10", "p90", "mean_exceedance", "maximum_exceedance", "cumulative_exceedance_km2_units", "perimeter_km", "compactness", "orientation_degrees", "elongation", "major_axis_length_km", "minor_axis_length_km", "centroid_dispersion_km", "edge_cell_fraction"]


def patch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, found = _found(spark, sf_dir)
    return report(patches.patch_table(cells, RULE, found).select("date", "patch_id", *_PATCH_COLUMNS, *[f"touches_{s}_boundary" for s in ("north", "south", "east", "west")], "status"), 4)


_Q = quantile_sql("found", "date, patch_id", "value", "area", {"median_source_value": 0.5, "p10": 0.1, "p90": 0.9})
_R = "6371.0088"
_TABLE = f"""q AS ({_Q}),
f AS (SELECT date, patch_id, count(*) AS cell_count, sum(area) AS area_km2, sum(lat * area) / sum(area) AS centroid_latitude, degrees(atan2(sum(area * sin(radians(lon))), sum(area * cos(radians(lon))))) AS centroid_longitude, sum(value * area) / sum(area) AS mean_source_value, min(value) AS minimum_source_value, max(value) AS maximum_source_value, sum(exceedance * area) / sum(area) AS mean_exceedance, max(exceedance) AS maximum_exceedance, sum(exceedance * area) AS cumulative_exceedance_km2_units, bool_or(row = (SELECT max(row) FROM cells)) AS touches_north_boundary, bool_or(row = 0) AS touches_south_boundary, bool_or(col = (SELECT max(col) FROM cells)) AS touches_east_boundary, bool_or(col = 0) AS touches_west_boundary FROM found GROUP BY ALL),
xy AS (SELECT x.date, x.patch_id, area, {_R} * radians(lon - centroid_longitude) * cos(radians(centroid_latitude)) AS x, {_R} * radians(lat - centroid_latitude) AS y FROM found x JOIN f USING (date, patch_id)),
m AS (SELECT date, patch_id, sum(x * x * area) / sum(area) AS xx, sum(y * y * area) / sum(area) AS yy, sum(x * y * area) / sum(area) AS xy, sum(x * area) / sum(area) AS mx, sum(y * area) / sum(area) AS my FROM xy GROUP BY ALL),
v AS (SELECT *, xx - mx * mx AS a, xy - mx * my AS b, yy - my * my AS c FROM m),
e AS (SELECT *, greatest((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 0) AS major, greatest((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 0) AS minor FROM v),
sides AS (SELECT date, patch_id, row, col, row + dr AS r2, col + dc AS c2, CASE WHEN dr = -1 THEN {_R} * radians(1.0) * cos(radians(lat - 0.5)) WHEN dr = 1 THEN {_R} * radians(1.0) * cos(radians(lat + 0.5)) ELSE {_R} * radians(1.0) END AS len FROM found, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS t(dr, dc)),
bare AS (SELECT * FROM sides s WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.date = s.date AND f.patch_id = s.patch_id AND f.row = s.r2 AND f.col = s.c2)),
p AS (SELECT date, patch_id, sum(len) AS perimeter_km, count(DISTINCT (row, col)) AS edge_cells FROM bare GROUP BY ALL),
tab AS (SELECT f.*, median_source_value, p10, p90, perimeter_km, 4 * pi() * area_km2 / (perimeter_km * perimeter_km) AS compactness, CASE WHEN major > 1e-6 THEN (round(degrees(atan2(2 * b, a - c)) / 2, 9) + 90 + 180) % 180 - 90 END AS orientation_degrees, CASE WHEN major > 1e-6 AND minor > 1e-6 THEN sqrt(major / minor) END AS elongation, 4 * sqrt(major) AS major_axis_length_km, 4 * sqrt(minor) AS minor_axis_length_km, sqrt(xx + yy) AS centroid_dispersion_km, edge_cells / cell_count AS edge_cell_fraction, CASE WHEN minor > 1e-6 THEN 'valid' ELSE 'warning' END AS status, CASE WHEN major <= 1e-6 THEN 'Patch cell centres have no two-dimensional spatial variance' WHEN minor <= 1e-6 THEN 'Patch minor-axis variance is zero; elongation is undefined' END AS reason FROM f JOIN q USING (date, patch_id) JOIN e USING (date, patch_id) JOIN p USING (date, patch_id))"""
PATCH_TABLE = rounded(f"{WITH}, {_TABLE} SELECT * FROM tab", ", ".join(_PATCH_COLUMNS[1:]), "date, patch_id, cell_count, status, touches_north_boundary, touches_south_boundary, touches_east_boundary, touches_west_boundary", 4)


def patch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, found = _found(spark, sf_dir)
    out = patches.daily_summary(cells, patches.patch_table(cells, RULE, found), RULE)
    return report(out.drop("reason", "patch_centroid_dispersion_km", "area_weighted_centroid_longitude"), 4)


_SUMMARY = ["total_patch_area_km2", "threshold_area_fraction", "largest_patch_area_km2", "largest_patch_fraction", "mean_patch_area_km2", "median_patch_area_km2", "patch_area_standard_deviation_km2", "patch_density_per_10000_km2", "fragmentation_index", "dominant_patch_fraction", "area_weighted_mean_patch_intensity", "maximum_patch_intensity", "area_weighted_centroid_latitude", "valid_coverage"]
PATCH_SUMMARY = rounded(
    f"""{WITH}, {_TABLE}, s AS (SELECT date, sum({_AREA}) AS va FROM cells GROUP BY date),
t AS (SELECT date, count(*) AS n, sum(area_km2) AS total, max(area_km2) AS largest, avg(area_km2) AS mean_area, quantile_cont(area_km2, 0.5) AS med, stddev_pop(area_km2) AS sd, sum(mean_exceedance * area_km2) / sum(area_km2) AS strength, max(maximum_exceedance) AS top, sum(centroid_latitude * area_km2) / sum(area_km2) AS lat, bool_or(status = 'warning') AS warn FROM tab GROUP BY date)
SELECT s.date, coalesce(n, 0) AS patch_count, coalesce(total, 0) AS total_patch_area_km2, coalesce(total / va, 0) AS threshold_area_fraction, coalesce(largest, 0) AS largest_patch_area_km2, coalesce(largest / va, 0) AS largest_patch_fraction, mean_area AS mean_patch_area_km2, med AS median_patch_area_km2, sd AS patch_area_standard_deviation_km2, coalesce(n / va * 10000, 0) AS patch_density_per_10000_km2, 1 - largest / total AS fragmentation_index, largest / total AS dominant_patch_fraction, strength AS area_weighted_mean_patch_intensity, top AS maximum_patch_intensity, lat AS area_weighted_centroid_latitude, 1.0 AS valid_coverage, CASE WHEN n IS NULL THEN 'not_calculated' WHEN warn THEN 'warning' ELSE 'valid' END AS status FROM s LEFT JOIN t USING (date)""",
    ", ".join(_SUMMARY),
    "date, patch_count, status",
    4,
)


def patch_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, score and acceptance of patches on consecutive dates."""
    cells, found = _found(spark, sf_dir)
    pairs = tracks.pair_metrics(found, patches.patch_table(cells, RULE, found), LINKS)
    return report(pairs.drop("rejection_reason", "boundary_touching_status"), 4)


_LINK = ["intersection_area_km2", "union_area_km2", "area_weighted_iou", "predecessor_overlap_fraction", "successor_overlap_fraction", "centroid_distance_km", "area_ratio", "log_area_ratio", "mean_intensity_difference", "maximum_intensity_difference", "link_score"]
_PAIRS = f"""d AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM found)),
sh AS (SELECT a.date AS d1, b.date AS d2, a.patch_id AS p, b.patch_id AS s, count(*) AS n, sum(a.area) AS sa FROM found a JOIN d ON d.date = a.date JOIN found b ON b.date = d.nx AND b.row = a.row AND b.col = a.col GROUP BY ALL),
j AS (SELECT sh.*, x.area_km2 AS pa, y.area_km2 AS sa2, y.mean_source_value - x.mean_source_value AS dm, y.maximum_source_value - x.maximum_source_value AS dx, 2 * {_R} * asin(sqrt(least(1, pow(sin(radians(y.centroid_latitude - x.centroid_latitude) / 2), 2) + cos(radians(x.centroid_latitude)) * cos(radians(y.centroid_latitude)) * pow(sin(radians(y.centroid_longitude - x.centroid_longitude) / 2), 2)))) AS km FROM sh JOIN tab x ON x.date = d1 AND x.patch_id = p JOIN tab y ON y.date = d2 AND y.patch_id = s),
k AS (SELECT *, pa + sa2 - sa AS un, sa2 / pa AS ratio FROM j),
z AS (SELECT *, 0.35 * sa / un + 0.2 * sa / pa + 0.2 * sa / sa2 + 0.15 * greatest(0, 1 - km / 500) + 0.1 * least(ratio, 1 / ratio) AS score, sa / un >= 0.05 OR sa / pa >= 0.15 OR sa / sa2 >= 0.15 AS ov, d2 - d1 AS el FROM k)"""
PATCH_LINKS = rounded(
    f"""{WITH}, {_TABLE}, {_PAIRS}
SELECT d1 AS predecessor_date, p AS predecessor_patch_id, d2 AS successor_date, s AS successor_patch_id, el AS elapsed_days, n AS intersection_cell_count, sa AS intersection_area_km2, un AS union_area_km2, sa / un AS area_weighted_iou, sa / pa AS predecessor_overlap_fraction, sa / sa2 AS successor_overlap_fraction, km AS centroid_distance_km, ratio AS area_ratio, ln(ratio) AS log_area_ratio, dm AS mean_intensity_difference, dx AS maximum_intensity_difference, CASE WHEN ov AND el <= 1 AND score >= 0.1 THEN 'accepted' ELSE 'rejected' END AS candidate_status, score AS link_score, CASE WHEN ov THEN 'overlap' WHEN el > 1 AND km <= 500 AND ratio BETWEEN 0.2 AND 5 THEN 'distance_fallback' END AS link_basis, el > 1 AS crosses_temporal_gap FROM z""",
    ", ".join(_LINK),
    "predecessor_date, predecessor_patch_id, successor_date, successor_patch_id, elapsed_days, intersection_cell_count, candidate_status, link_basis, crosses_temporal_gap",
    4,
)


def _lineage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells, found = _found(spark, sf_dir)
    table = stage(patches.patch_table(cells, RULE, found), "patches")
    return tracks.lineage(table, tracks.links(found, table, LINKS))


_LISTS = ("parent_node_ids", "child_node_ids", "parent_track_ids", "child_track_ids")
_TURNS = ("mean_bearing_degrees", "net_bearing_degrees")


def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations; lists of ids are joined by commas."""
    nodes = _lineage(spark, sf_dir)[0]
    return report(nodes.withColumns({c: F.array_join(c, ",") for c in _LISTS}), 4)


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_lineage(spark, sf_dir)[1], 4)


def track_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of tracks; a bearing that rounds to a full turn is 0."""
    out = report(tracks.track_metrics(_lineage(spark, sf_dir)[0]), 4)
    return out.withColumns({c: F.pmod(c, F.lit(360.0)) for c in _TURNS})


def family_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(tracks.family_metrics(_lineage(spark, sf_dir)[0]), 4)


def track_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, found = _found(spark, sf_dir)
    table = stage(patches.patch_table(cells, RULE, found), "patches")
    return report(assembly.track_labels(found, tracks.lineage(table, tracks.links(found, table, LINKS))[0]), 4)


def _node(day: str, patch: str) -> str:
    return f"strftime({day}, '%Y-%m-%d') || '::P' || lpad(CAST({patch} AS VARCHAR), 6, '0')"


def _km(y1: str, x1: str, y2: str, x2: str) -> str:
    return f"2 * {_R} * asin(sqrt(least(1, pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"


def _bearing(y1: str, x1: str, y2: str, x2: str) -> str:
    along = f"cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos(radians({x2} - {x1}))"
    return f"CASE WHEN abs({y2} - {y1}) >= 1e-12 OR abs({x2} - {x1}) >= 1e-12 THEN (degrees(atan2(sin(radians({x2} - {x1})) * cos(radians({y2})), {along})) + 360) % 360 END"


def _numbers(name: str, edges: str, key: str, letter: str) -> str:
    """CTEs up to ``name`` (``node``, ``key``): components of ``edges`` numbered by their first node."""
    return f"""{name}u AS (SELECT a AS x, b AS y FROM {edges} UNION SELECT b, a FROM {edges}),
{name}r AS (SELECT node AS x, node AS m FROM nd UNION SELECT u.y, r.m FROM {name}r r JOIN {name}u u ON u.x = r.x WHERE r.m < u.y),
{name}c AS (SELECT x AS node, min(m) AS component FROM {name}r GROUP BY x),
{name}f AS (SELECT component, min((date, round(centroid_latitude, 9), round(centroid_longitude, 9), patch_id)) AS first FROM {name}c JOIN nd USING (node) GROUP BY component),
{name} AS (SELECT node, '{letter}' || lpad(CAST(rank AS VARCHAR), 6, '0') AS {key} FROM {name}c JOIN (SELECT component, row_number() OVER (ORDER BY first, component) AS rank FROM {name}f) USING (component))"""


#: Edges of a node with one link on either side are in every best assignment; of the others all matchings are compared.
_LINEAGE = f"""acc AS (SELECT *, sa / un AS iou, {_node('d1', 'p')} AS a, {_node('d2', 's')} AS b FROM z WHERE ov AND el <= 1 AND score >= 0.1),
eo AS (SELECT *, count(*) OVER (PARTITION BY a) AS outs, count(*) OVER (PARTITION BY b) AS ins FROM acc),
amb AS (SELECT d1, p, s, score + iou * 1e-10 AS score, row_number() OVER (PARTITION BY d1 ORDER BY p, s) AS k FROM eo WHERE outs > 1 OR ins > 1),
pick AS (SELECT DISTINCT d1, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS ss, CAST(0 AS DOUBLE) AS total FROM amb UNION ALL
  SELECT x.d1, m.k, CASE WHEN t THEN list_append(ps, m.p) ELSE ps END, CASE WHEN t THEN list_append(ss, m.s) ELSE ss END, CASE WHEN t THEN total + score ELSE total END FROM pick x JOIN amb m ON m.d1 = x.d1 AND m.k = x.k + 1, (VALUES (true), (false)) AS v(t) WHERE NOT t OR NOT (list_contains(ps, m.p) OR list_contains(ss, m.s))),
best AS (SELECT d1, arg_max(ps, total) AS ps, arg_max(ss, total) AS ss FROM pick JOIN (SELECT d1, max(k) AS k FROM amb GROUP BY d1) USING (d1, k) GROUP BY d1),
bone AS (SELECT d1, unnest(ps) AS p, unnest(ss) AS s FROM best),
ed AS (SELECT eo.*, (outs = 1 AND ins = 1) OR bone.p IS NOT NULL AS backbone FROM eo LEFT JOIN bone ON bone.d1 = eo.d1 AND bone.p = eo.p AND bone.s = eo.s),
chain AS (SELECT a, b FROM ed WHERE backbone AND outs = 1 AND ins = 1),
nd AS (SELECT *, {_node('date', 'patch_id')} AS node FROM tab),
{_numbers('trk', 'chain', 'track_id', 'T')},
{_numbers('fam', 'ed', 'event_family_id', 'F')},
up AS (SELECT b AS node, string_agg(a, ',' ORDER BY a) AS parents, count(*) AS np, max(outs) AS mo, max(CASE WHEN backbone THEN a END) AS bp, bool_or(el > 1) AS gap FROM ed GROUP BY b),
dn AS (SELECT a AS node, string_agg(b, ',' ORDER BY b) AS children, count(*) AS nc, max(ins) AS mi, max(CASE WHEN backbone THEN b END) AS bc FROM ed GROUP BY a),
upt AS (SELECT b AS node, string_agg(DISTINCT track_id, ',' ORDER BY track_id) AS parent_tracks FROM ed JOIN trk ON trk.node = ed.a GROUP BY b),
dnt AS (SELECT a AS node, string_agg(DISTINCT track_id, ',' ORDER BY track_id) AS child_tracks FROM ed JOIN trk ON trk.node = ed.b GROUP BY a),
dg AS (SELECT nd.*, track_id, event_family_id, coalesce(np, 0) AS np, coalesce(nc, 0) AS nc, coalesce(mo, 0) AS mo, coalesce(mi, 0) AS mi, parents, children, parent_tracks, child_tracks, bp, bc, coalesce(gap, false) AS gap FROM nd JOIN trk USING (node) JOIN fam USING (node) LEFT JOIN up USING (node) LEFT JOIN dn USING (node) LEFT JOIN upt USING (node) LEFT JOIN dnt USING (node)),
ob AS (SELECT *, CASE WHEN (nc >= 2 OR mo >= 2) AND (np >= 2 OR mi >= 2) THEN 'complex_branch' WHEN nc >= 2 THEN 'split_parent' WHEN np >= 2 THEN 'merge_child' WHEN mo >= 2 THEN 'split_child' WHEN mi >= 2 THEN 'merge_parent' WHEN np = 0 AND nc = 0 THEN 'isolated_single_day' WHEN np = 0 THEN 'appearance' WHEN nc = 0 THEN 'termination' WHEN np = 1 AND nc = 1 AND mo = 1 AND mi = 1 THEN 'continuation' ELSE 'complex_branch' END AS kind, touches_north_boundary OR touches_south_boundary OR touches_east_boundary OR touches_west_boundary AS edge FROM dg)"""
_WITH_LINEAGE = f"{WITH}, {_TABLE}, {_PAIRS}, {_LINEAGE}"
_OBSERVED = ["area_km2", "centroid_latitude", "centroid_longitude", "mean_source_value", "maximum_source_value", "mean_exceedance", "maximum_exceedance"]
_SIDES = [f"touches_{s}_boundary" for s in ("north", "south", "east", "west")]
LINEAGE_NODES = rounded(
    f"""{_WITH_LINEAGE} SELECT *, node AS node_id, patch_id AS local_patch_id, kind AS node_event_type, 'anomaly' AS source_variable, 'fixed' AS threshold_type, 'above' AS direction, coalesce(parents, '') AS parent_node_ids, coalesce(children, '') AS child_node_ids, coalesce(parent_tracks, '') AS parent_track_ids, coalesce(child_tracks, '') AS child_track_ids, np AS predecessor_count, nc AS successor_count, bp AS continuation_backbone_parent, bc AS continuation_backbone_child, gap AS link_crossed_temporal_gap, 1.0 AS valid_coverage, CAST(NULL AS VARCHAR) AS climatology_method, 'unknown' AS data_mode FROM ob""",
    ", ".join([*_OBSERVED, "valid_coverage"]),
    ", ".join(["node_id", "date", "local_patch_id", "track_id", "event_family_id", "node_event_type", "source_variable", "threshold_type", "direction", *_LISTS, "predecessor_count", "successor_count", "continuation_backbone_parent", "continuation_backbone_child", "link_crossed_temporal_gap", "climatology_method", "data_mode", "status", "reason", *_SIDES]),
    4,
)
LINEAGE_EDGES = rounded(
    f"""{_WITH_LINEAGE} SELECT a AS predecessor_node_id, b AS successor_node_id, d1 AS predecessor_date, d2 AS successor_date, p AS predecessor_patch_id, s AS successor_patch_id, el AS elapsed_days, n AS intersection_cell_count, sa AS intersection_area_km2, un AS union_area_km2, iou AS area_weighted_iou, sa / pa AS predecessor_overlap_fraction, sa / sa2 AS successor_overlap_fraction, km AS centroid_distance_km, ratio AS area_ratio, score AS link_score, 'overlap' AS link_basis, backbone AS is_continuation_backbone,
CASE WHEN outs >= 2 AND ins >= 2 THEN 'complex' WHEN outs >= 2 THEN 'split' WHEN ins >= 2 THEN 'merge' ELSE 'continuation' END AS lineage_relation, el > 1 AS crosses_temporal_gap, 'valid' AS status, CAST(NULL AS VARCHAR) AS reason FROM ed""",
    "intersection_area_km2, union_area_km2, area_weighted_iou, predecessor_overlap_fraction, successor_overlap_fraction, centroid_distance_km, area_ratio, link_score",
    "predecessor_node_id, successor_node_id, predecessor_date, successor_date, predecessor_patch_id, successor_patch_id, elapsed_days, intersection_cell_count, link_basis, is_continuation_backbone, lineage_relation, crosses_temporal_gap, status, reason",
    4,
)
TRACK_LABELS = rounded(
    f"""{_WITH_LINEAGE} SELECT f.date, f.patch_id, row, col, lat, lon, value, area, exceedance, row = (SELECT max(row) FROM cells) AS north, row = (SELECT min(row) FROM cells) AS south, col = (SELECT max(col) FROM cells) AS east, col = (SELECT min(col) FROM cells) AS west, track_id, event_family_id, kind AS node_event_type, dense_rank() OVER (ORDER BY track_id) AS track_id_number, dense_rank() OVER (ORDER BY event_family_id) AS event_family_id_number FROM found f JOIN ob ON ob.date = f.date AND ob.patch_id = f.patch_id""",
    "lat, lon, value, area, exceedance",
    f"date, patch_id, {_CELL}, north, south, east, west, track_id, event_family_id, node_event_type, track_id_number, event_family_id_number",
    4,
)


def _movement(source: str, key: str) -> str:
    """CTEs ``steps`` and ``mv`` of the centroids of ``source`` per ``key``."""
    ends = [f"{f}(centroid_{c}, date)" for f in ("arg_min", "arg_max") for c in ("latitude", "longitude")]
    return f"""was AS (SELECT *, lag(centroid_latitude) OVER w AS y0, lag(centroid_longitude) OVER w AS x0, date - lag(date) OVER w AS days FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY date)),
steps AS (SELECT *, CASE WHEN y0 IS NOT NULL THEN {_km('y0', 'x0', 'centroid_latitude', 'centroid_longitude')} END AS km, {_bearing('y0', 'x0', 'centroid_latitude', 'centroid_longitude')} AS turn FROM was),
mv AS (SELECT {key}, count(*) AS n, sum(km) AS length, max(km / days) AS top, sum(days) AS span, (degrees(atan2(avg(sin(radians(turn))), avg(cos(radians(turn))))) + 360) % 360 AS bearing, {ends[0]} AS ya, {ends[1]} AS xa, {ends[2]} AS yz, {ends[3]} AS xz FROM steps GROUP BY {key}),
mw AS (SELECT *, {_km('ya', 'xa', 'yz', 'xz')} AS net, {_bearing('ya', 'xa', 'yz', 'xz')} AS net_turn FROM mv)"""


_UNITS = "'km2' AS area_unit, 'source-variable unit km2 day' AS cumulative_severity_unit, 'km' AS movement_unit, 'km day-1' AS speed_unit"
_TRACK = ["mean_area_km2", "median_area_km2", "maximum_area_km2", "minimum_area_km2", "area_standard_deviation_km2", "observed_area_days_km2_days", "area_weighted_mean_exceedance", "maximum_exceedance", "mean_source_value", "maximum_source_value", "cumulative_severity", "mean_area_change_km2_per_day", "maximum_expansion_rate_km2_per_day", "maximum_contraction_rate_km2_per_day", "relative_area_change", "net_displacement_km", "trajectory_length_km", "mean_speed_km_per_day", "maximum_speed_km_per_day", "trajectory_tortuosity", "start_centroid_latitude", "start_centroid_longitude", "end_centroid_latitude", "end_centroid_longitude", *_TURNS]
_TRACK_TABLE = rounded(
    f"""{_WITH_LINEAGE}, {_movement('ob', 'track_id')},
ch AS (SELECT *, (area_km2 - lag(area_km2) OVER w) / (date - lag(date) OVER w) AS change, date - lag(date) OVER w AS step FROM ob WINDOW w AS (PARTITION BY track_id ORDER BY date)),
tr AS (SELECT track_id, min(event_family_id) AS event_family_id, min(date) AS start_date, max(date) AS end_date, count(*) AS observed_days, max(date) - min(date) + 1 AS duration_calendar_days, count(*) FILTER (step > 1) AS internal_gap_count, arg_min(kind, date) AS start_event_type, arg_max(kind, date) AS end_event_type, avg(area_km2) AS mean_area_km2, quantile_cont(area_km2, 0.5) AS median_area_km2, max(area_km2) AS maximum_area_km2, min(area_km2) AS minimum_area_km2, stddev_pop(area_km2) AS area_standard_deviation_km2, sum(area_km2) AS observed_area_days_km2_days, sum(mean_exceedance * area_km2) / sum(area_km2) AS area_weighted_mean_exceedance, max(maximum_exceedance) AS maximum_exceedance, sum(mean_source_value * area_km2) / sum(area_km2) AS mean_source_value, max(maximum_source_value) AS maximum_source_value, sum(mean_exceedance * area_km2) AS cumulative_severity, avg(change) AS mean_area_change_km2_per_day, max(change) FILTER (change > 0) AS maximum_expansion_rate_km2_per_day, min(change) FILTER (change < 0) AS maximum_contraction_rate_km2_per_day, (arg_max(area_km2, date) - arg_min(area_km2, date)) / arg_min(area_km2, date) AS relative_area_change, count(*) FILTER (change > 0) AS expansion_day_count, count(*) FILTER (change < 0) AS contraction_day_count, {', '.join(f'bool_or({c}) AS {c.replace("touches", "touched")}' for c in _SIDES)}, count(*) FILTER (edge) AS boundary_contact_day_count FROM ch GROUP BY track_id),
j2 AS (SELECT *, CASE WHEN n >= 2 THEN net ELSE 0 END AS net_displacement_km, CASE WHEN n >= 2 THEN length ELSE 0 END AS trajectory_length_km, CASE WHEN span > 0 THEN length / span END AS mean_speed_km_per_day, top AS maximum_speed_km_per_day, bearing AS mean_bearing_degrees, CASE WHEN n >= 2 THEN net_turn END AS net_bearing_degrees, CASE WHEN n >= 2 AND net > 1e-12 THEN length / net END AS trajectory_tortuosity, ya AS start_centroid_latitude, xa AS start_centroid_longitude, yz AS end_centroid_latitude, xz AS end_centroid_longitude FROM tr JOIN mw USING (track_id))
SELECT *, {_UNITS}, 'km2 day' AS observed_area_days_unit, 'source-variable unit' AS exceedance_unit, CASE WHEN observed_days = 1 THEN 'Movement and area-change rates require at least two observations' WHEN trajectory_tortuosity IS NULL THEN 'Trajectory tortuosity is not calculated for zero net displacement' END AS reason, CASE WHEN observed_days = 1 OR trajectory_tortuosity IS NULL THEN 'warning' ELSE 'valid' END AS status FROM j2""",
    ", ".join(_TRACK),
    ", ".join(["track_id", "event_family_id", "start_date", "end_date", "observed_days", "duration_calendar_days", "internal_gap_count", "start_event_type", "end_event_type", "expansion_day_count", "contraction_day_count", *[c.replace("touches", "touched") for c in _SIDES], "boundary_contact_day_count", "area_unit", "observed_area_days_unit", "exceedance_unit", "cumulative_severity_unit", "movement_unit", "speed_unit", "status", "reason"]),
    4,
)
TRACK_TABLE = f"SELECT * REPLACE ({', '.join(f'{c} % 360 AS {c}' for c in _TURNS)}) FROM ({_TRACK_TABLE})"
_FAMILY = ["family_area_days_km2_days", "maximum_patch_area_km2", "area_weighted_mean_exceedance", "maximum_exceedance", "cumulative_severity", "mean_total_daily_area_km2", "maximum_total_daily_area_km2", "start_centroid_latitude", "start_centroid_longitude", "end_centroid_latitude", "end_centroid_longitude", "family_net_displacement_km", "family_trajectory_length_km", "mean_family_speed_km_per_day", "maximum_family_extent_km"]
FAMILY_TABLE = rounded(
    f"""{_WITH_LINEAGE}, fd AS (SELECT event_family_id, date, sum(area_km2) AS area, count(*) AS many, sum(centroid_latitude * area_km2) / sum(area_km2) AS centroid_latitude, degrees(atan2(sum(area_km2 * sin(radians(centroid_longitude))), sum(area_km2 * cos(radians(centroid_longitude))))) AS centroid_longitude FROM ob GROUP BY ALL),
{_movement('fd', 'event_family_id')},
own AS (SELECT event_family_id, min(date) AS start_date, max(date) AS end_date, max(date) - min(date) + 1 AS duration_calendar_days, count(*) AS observed_patch_days, count(DISTINCT track_id) AS track_count, count(DISTINCT node) AS unique_patch_observation_count, count(*) FILTER (kind = 'split_parent') AS split_count, count(*) FILTER (kind = 'merge_child') AS merge_count, count(*) FILTER (kind = 'complex_branch') AS complex_branch_count, sum(area_km2) AS family_area_days_km2_days, max(area_km2) AS maximum_patch_area_km2, sum(mean_exceedance * area_km2) / sum(area_km2) AS area_weighted_mean_exceedance, max(maximum_exceedance) AS maximum_exceedance, sum(mean_exceedance * area_km2) AS cumulative_severity, count(DISTINCT date) FILTER (edge) AS boundary_contact_day_count FROM ob GROUP BY ALL),
dy AS (SELECT event_family_id, max(many) AS maximum_simultaneous_patch_count, avg(area) AS mean_total_daily_area_km2, max(area) AS maximum_total_daily_area_km2, count(*) AS dates FROM fd GROUP BY ALL),
ex AS (SELECT o.event_family_id, max({_km('o.centroid_latitude', 'o.centroid_longitude', 't.centroid_latitude', 't.centroid_longitude')}) AS extent FROM ob o JOIN ob t ON t.event_family_id = o.event_family_id AND t.date = o.date AND o.node < t.node GROUP BY ALL)
SELECT *, ya AS start_centroid_latitude, xa AS start_centroid_longitude, yz AS end_centroid_latitude, xz AS end_centroid_longitude, CASE WHEN n >= 2 THEN net ELSE 0 END AS family_net_displacement_km, CASE WHEN n >= 2 THEN length ELSE 0 END AS family_trajectory_length_km, CASE WHEN span > 0 THEN length / span END AS mean_family_speed_km_per_day, coalesce(extent, 0) AS maximum_family_extent_km, {_UNITS}, 'km2 day' AS family_area_days_unit, CAST(NULL AS VARCHAR) AS climatology_method, 'unknown' AS data_mode, CASE WHEN dates < 2 THEN 'warning' ELSE 'valid' END AS status, CASE WHEN dates < 2 THEN 'Family movement rates require at least two observed dates' END AS reason FROM own JOIN dy USING (event_family_id) JOIN mw USING (event_family_id) LEFT JOIN ex USING (event_family_id)""",
    ", ".join(_FAMILY),
    "event_family_id, start_date, end_date, duration_calendar_days, observed_patch_days, track_count, unique_patch_observation_count, split_count, merge_count, complex_branch_count, boundary_contact_day_count, climatology_method, data_mode, maximum_simultaneous_patch_count, area_unit, family_area_days_unit, cumulative_severity_unit, movement_unit, speed_unit, status, reason",
    4,
)


def moran_rook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spatial.moran(full_grid(grid_cells(spark, sf_dir, 20, 20)), "rook", minimum_coverage=0.7).drop("coverage"))


def moran_queen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spatial.moran(full_grid(grid_cells(spark, sf_dir, 20, 20)), "queen", row_standardized=False, minimum_coverage=0.7).drop("coverage"))


def _moran_sql(kind: str, near: str, weight: str) -> str:
    return rounded(
        f"""WITH {grid_sql(20, 20)}, {FULL_SQL}, st AS (SELECT date, count(value) AS n, avg(value) AS mean, sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) END) / sum(cos(radians(lat))) AS cov FROM full_cells GROUP BY date),
z AS (SELECT c.date, row, col, value - mean AS z FROM cells c JOIN st USING (date)), p AS (SELECT a.date, a.row, a.col, a.z, b.z AS z2, count(*) OVER (PARTITION BY a.date, a.row, a.col) AS k FROM z a JOIN z b ON a.date = b.date AND {near}),
s AS (SELECT date, sum({weight}) AS s0, sum({weight} * z * z2) AS cr FROM p GROUP BY date), q AS (SELECT date, sum(z * z) AS sq FROM z GROUP BY date)
SELECT date, CASE WHEN cov >= 0.7 AND n >= 3 THEN n / s0 * cr / sq END AS moran_i_{kind}, n FROM st LEFT JOIN s USING (date) LEFT JOIN q USING (date)""",
        f"moran_i_{kind}",
        "date, n",
    )


MORAN_ROOK = _moran_sql("rook", "abs(a.row - b.row) + abs(a.col - b.col) = 1", "1.0 / k")
MORAN_QUEEN = _moran_sql("queen", "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)", "1.0")


def local_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spatial.local_deviation(grid_cells(spark, sf_dir)).select("date", "row", "col", "local_sd"))


LOCAL_TEXTURE = rounded(
    f"WITH {GRID} SELECT a.date, a.row, a.col, CASE WHEN count(b.value) >= 2 THEN stddev_pop(b.value) END AS local_sd FROM cells a JOIN cells b ON a.date = b.date AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL",
    "local_sd",
    f"date, {_CELL}",
)


def thermal_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spatial.thermal_gradient(full_grid(grid_cells(spark, sf_dir))).select("date", "row", "col", "gradient"))


_SLOPE = "CASE WHEN lag({x}) OVER {w} IS NULL THEN (lead(value) OVER {w} - value) / (lead({x}) OVER {w} - {x}) WHEN lead({x}) OVER {w} IS NULL THEN (value - lag(value) OVER {w}) / ({x} - lag({x}) OVER {w}) ELSE (lead(value) OVER {w} - lag(value) OVER {w}) / (lead({x}) OVER {w} - lag({x}) OVER {w}) END"
THERMAL_GRADIENT = rounded(
    f"WITH {GRID}, {FULL_SQL}, g AS (SELECT *, {_SLOPE.format(x='lat', w='r')} AS dy, {_SLOPE.format(x='lon', w='c')} AS dx FROM full_cells WINDOW r AS (PARTITION BY date, col ORDER BY row), c AS (PARTITION BY date, row ORDER BY col)) SELECT date, row, col, CASE WHEN value IS NOT NULL THEN sqrt(dx * dx + dy * dy) END AS gradient FROM g",
    "gradient",
    f"date, {_CELL}",
)


def threshold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spatial.threshold_features(grid_cells(spark, sf_dir), 28.0))


THRESHOLD_FEATURES = rounded(
    f"""WITH {GRID}, e AS (SELECT *, cos(radians(lat)) AS w, greatest(value - 28, 0) * cos(radians(lat)) AS e FROM cells),
f AS (SELECT date, 100.0 * sum(CASE WHEN value > 28 THEN w ELSE 0 END) / sum(w) AS area_over_threshold, sum(e) / sum(w) AS weighted_excess_above_threshold, sum(e * lat) / sum(e) AS centroid_latitude, sum(e * lon) / sum(e) AS centroid_longitude FROM e GROUP BY date)
SELECT f.*, sqrt(d) AS centroid_dispersion FROM f JOIN (SELECT date, sum(e * (pow(lat - centroid_latitude, 2) + pow(lon - centroid_longitude, 2))) / sum(e) AS d FROM e JOIN f USING (date) GROUP BY date) USING (date)""",
    "area_over_threshold, weighted_excess_above_threshold, centroid_latitude, centroid_longitude, centroid_dispersion",
    "date",
)


def patch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spatial.patch_features(grid_cells(spark, sf_dir), 30.0, "rook", 3), 4)


PATCH_FEATURES = rounded(
    f"""{WITH}, k AS (SELECT *, cos(radians(lat)) AS w FROM found), ar AS (SELECT date, patch_id, sum(w) AS a FROM k GROUP BY ALL),
t AS (SELECT date, count(*) AS patch_count, sum(a) AS total_threshold_area, max(a) AS largest_patch_area, avg(a) AS mean_patch_area, stddev_pop(a) AS patch_area_standard_deviation, 1 - sum(a * a) / (sum(a) * sum(a)) AS fragmentation_index FROM ar GROUP BY date),
i AS (SELECT date, count(*) AS inn FROM (SELECT a.date, a.row, a.col FROM k a JOIN k b ON a.date = b.date AND abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY ALL HAVING count(*) = 4) GROUP BY date),
c AS (SELECT date, sum(w * lon) / sum(w) AS x, sum(w * lat) / sum(w) AS y, count(*) AS n FROM k GROUP BY date),
m AS (SELECT date, sum(w * (lon - x) * (lon - x)) / sum(w) AS a, sum(w * (lon - x) * (lat - y)) / sum(w) AS b, sum(w * (lat - y) * (lat - y)) / sum(w) AS c FROM k JOIN c USING (date) GROUP BY date),
e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS major, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS minor FROM m),
v AS (SELECT date, sum(cos(radians(lat))) AS va FROM cells GROUP BY date)
SELECT v.date, coalesce(patch_count, 0) AS patch_count, coalesce(total_threshold_area, 0) AS total_threshold_area, coalesce(largest_patch_area, 0) AS largest_patch_area, largest_patch_area / total_threshold_area AS largest_patch_fraction, coalesce(patch_count, 0) / va AS patch_density, coalesce(mean_patch_area, 0) AS mean_patch_area, coalesce(patch_area_standard_deviation, 0) AS patch_area_standard_deviation, coalesce(fragmentation_index, 0) AS fragmentation_index,
1 - coalesce(inn, 0) / n AS edge_cell_fraction, sqrt(a + c) AS centroid_dispersion, CASE WHEN major > 1e-9 THEN (round(degrees(atan2(2 * b, a - c)) / 2, 9) + 90 + 180) % 180 - 90 END AS orientation, CASE WHEN minor > 1e-9 THEN sqrt(major / minor) END AS elongation FROM v LEFT JOIN t USING (date) LEFT JOIN i USING (date) LEFT JOIN c USING (date) LEFT JOIN e USING (date)""",
    "total_threshold_area, largest_patch_area, largest_patch_fraction, patch_density, mean_patch_area, patch_area_standard_deviation, fragmentation_index, edge_cell_fraction, centroid_dispersion, orientation, elongation",
    "date, patch_count",
    4,
)

CLASSES = spatial.ClassRule(strong_signal_c=2.0, weak_signal_c=0.8, neutral_band_c=0.5, heterogeneous_sd_c=6.0, minimum_coverage=0.75, minimum_signal_heterogeneity_ratio=0.3, dominant_patch_fraction=0.9)


def representativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = daily.time_mean_anomalies(full_grid(grid_cells(spark, sf_dir, 20, 20))).drop("value").withColumnRenamed("anomaly", "value")
    return report(spatial.classified(spatial.class_inputs(cells, CLASSES, "rook", 3), CLASSES), 4)


def _sign_sql(sign: str, name: str) -> str:
    return f"""{name}m AS (SELECT *, {_KEY} AS k FROM an WHERE {sign}),
{name}n AS (SELECT a.date, a.k, b.k AS k2 FROM {name}m a JOIN {name}m b ON a.date = b.date AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
{name}r AS (SELECT date, k, k AS m FROM {name}m UNION SELECT n.date, n.k2, r.m FROM {name}r r JOIN {name}n n ON n.date = r.date AND n.k = r.k WHERE r.m < n.k2),
{name}l AS (SELECT date, k, min(m) AS label FROM {name}r GROUP BY ALL),
{name}a AS (SELECT date, label, count(*) AS n, sum(w) AS a FROM {name}m JOIN {name}l USING (date, k) GROUP BY ALL HAVING count(*) >= 3)"""


_CQ = quantile_sql("an", "date", "value", "w", {"weighted_median_anomaly": 0.5, "p25": 0.25, "p75": 0.75})
_CLASS_INPUTS = ["valid_coverage", "weighted_mean_anomaly", "weighted_median_anomaly", "spatial_standard_deviation", "weighted_iqr", "positive_fraction", "negative_fraction", "neutral_fraction", "sign_coherence", "signal_heterogeneity_ratio", "mean_median_difference", "dominant_patch_fraction", "patch_density", "warm_area_fraction", "cold_area_fraction", "coexistence_index", "spatial_compensation_index"]
_CLIP = "least(1, greatest(0, {}))"


def _mean_of(*xs: str) -> str:
    return "(" + " + ".join(_CLIP.format(x) for x in xs) + f") / {len(xs)}"


_RULES = [
    ("valid_coverage < 0.75", "insufficient_coverage", "not_calculated", "coverage_below_minimum", _CLIP.format("1 - valid_coverage / 0.75")),
    ("m >= 2 AND sign_coherence >= 0.7 AND sd < 6 AND ra >= 0.3", "strong_coherent", "valid", "strong_signal_and_coherent_sign", _mean_of("m / 2.0", "sign_coherence / 0.7", "ra / 0.3", "1 - sd / 6")),
    ("m >= 2 AND (sd >= 6 OR ra < 0.3)", "strong_heterogeneous", "valid", "strong_signal_with_high_heterogeneity", _mean_of("m / 2.0", "greatest(sd / 6, 0.3 / (ra + 1e-9))")),
    ("m <= 0.8 AND positive_fraction >= 0.25 AND negative_fraction >= 0.25", "compensated_mixed", "valid", "opposing_signs_with_compensated_mean", _mean_of("1 - m / 0.8", "positive_fraction / 0.25", "negative_fraction / 0.25", "spatial_compensation_index")),
    ("dominant_patch_fraction <= 0.9 AND patch_density >= 0.01 AND positive_fraction + negative_fraction >= 0.25", "patch_distributed", "valid", "distributed_non_neutral_patches", _mean_of("1 - dominant_patch_fraction / 0.9", "patch_density / 0.01", "(positive_fraction + negative_fraction) / 0.25")),
    ("m <= 0.8 AND neutral_fraction >= 0.7 AND sd < 6", "weak_homogeneous", "valid", "weak_signal_and_neutral_homogeneity", _mean_of("1 - m / 0.8", "neutral_fraction / 0.7", "1 - sd / 6")),
]


def _case(i: int, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i] if i == 4 else repr(r[i])}" for r in _RULES) + f" ELSE {last} END"


REPRESENTATIVENESS = rounded(
    f"""WITH RECURSIVE {grid_sql(20, 20)}, {FULL_SQL}, an AS (SELECT date, row, col, lat, cos(radians(lat)) AS w, value - avg(value) OVER (PARTITION BY row, col) AS value FROM full_cells),
{_sign_sql("value > 0.5", "po")}, {_sign_sql("value < -0.5", "ne")}, q AS ({_CQ}),
f AS (SELECT date, sum(CASE WHEN value IS NOT NULL THEN w END) AS vw, sum(CASE WHEN value IS NOT NULL THEN w ELSE 0 END) / sum(w) AS valid_coverage, sum(value * w) / sum(CASE WHEN value IS NOT NULL THEN w END) AS mean, sum(CASE WHEN value > 0.5 THEN w ELSE 0 END) AS pw, sum(CASE WHEN value < -0.5 THEN w ELSE 0 END) AS nw, sum(abs(value) * w) AS aw, sum(CASE WHEN value >= 2 THEN w ELSE 0 END) AS ww, sum(CASE WHEN value <= -2 THEN w ELSE 0 END) AS cw FROM an GROUP BY date),
s AS (SELECT date, sqrt(sum(w * pow(value - mean, 2)) / sum(CASE WHEN value IS NOT NULL THEN w END)) AS sd FROM an JOIN f USING (date) GROUP BY date),
p AS (SELECT date, max(a) / sum(a) AS dominant_patch_fraction, count(*) AS n FROM (SELECT * FROM poa UNION ALL SELECT * FROM nea) GROUP BY date),
i AS (SELECT date, valid_coverage, mean AS weighted_mean_anomaly, weighted_median_anomaly, sd AS spatial_standard_deviation, p75 - p25 AS weighted_iqr, pw / vw AS positive_fraction, nw / vw AS negative_fraction, (vw - pw - nw) / vw AS neutral_fraction, abs(pw - nw) / vw AS sign_coherence, abs(mean) / (sd + 1e-9) AS signal_heterogeneity_ratio, abs(mean - weighted_median_anomaly) / (p75 - p25 + 1e-9) AS mean_median_difference, dominant_patch_fraction, coalesce(n, 0) / vw AS patch_density, ww / vw AS warm_area_fraction, cw / vw AS cold_area_fraction, least(1, 2 * least(pw, nw) / vw) AS coexistence_index, {_CLIP.format('1 - abs(mean) / (aw / vw)')} AS spatial_compensation_index, abs(mean) AS m, sd, abs(mean) / (sd + 1e-9) AS ra FROM f JOIN q USING (date) JOIN s USING (date) LEFT JOIN p USING (date))
SELECT *, {_case(1, "'unclassified'")} AS class, {_case(2, "'not_calculated'")} AS status, {_case(3, "'no_ordered_rule_satisfied'")} AS triggered_rule, {_case(4, "0")} AS evidence_score FROM i""",
    ", ".join([*_CLASS_INPUTS, "evidence_score"]),
    "date, class, status, triggered_rule",
    4,
)


def spatial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spatial features of the anomalies in the long form."""
    cells = daily.time_mean_anomalies(full_grid(grid_cells(spark, sf_dir))).drop("value").withColumnRenamed("anomaly", "value")
    return report(assembly.spatial_feature_table(cells, variable="anomaly", unit="degrees_Celsius", threshold=4.0, kind="rook"))


QUERIES = {
    "spatial_features": (spatial_features, None), "track_labels": (track_labels, TRACK_LABELS),
    "patch_labels": (patch_labels, PATCH_LABELS), "patch_table": (patch_table, PATCH_TABLE), "patch_summary": (patch_summary, PATCH_SUMMARY), "patch_links": (patch_links, PATCH_LINKS),
    "lineage_nodes": (lineage_nodes, LINEAGE_NODES), "lineage_edges": (lineage_edges, LINEAGE_EDGES), "track_table": (track_table, TRACK_TABLE), "family_table": (family_table, FAMILY_TABLE),
    "moran_rook": (moran_rook, MORAN_ROOK), "moran_queen": (moran_queen, MORAN_QUEEN), "local_texture": (local_texture, LOCAL_TEXTURE), "thermal_gradient": (thermal_gradient, THERMAL_GRADIENT),
    "threshold_features": (threshold_features, THRESHOLD_FEATURES), "patch_features": (patch_features, PATCH_FEATURES), "representativeness": (representativeness, REPRESENTATIVENESS),
}
