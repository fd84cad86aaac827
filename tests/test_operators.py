"""Facts with known answers, and random comparisons with plain re-statements of the rules."""

import datetime as dt
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.functions import statistics as S
from isobath.operators import climatology, events, facts, graph, overview, patches, quality, regional, spatial, temporal, tracks
from isobath.sources import cells as cell_sources
from isobath.sources import sinks

DAY = dt.date(2024, 1, 1)


def days(n, start=DAY):
    return [start + dt.timedelta(i) for i in range(n)]


def grid(spark, fields, lat0=0.0, lon0=0.0):
    rows = [(d, i, j, lat0 + i, lon0 + j, None if v is None else float(v)) for d, field in zip(days(len(fields)), fields, strict=True) for i, line in enumerate(field) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "date date, row int, col int, lat double, lon double, value double")


def test_stable_days(spark):
    rows = spark.createDataFrame([(dt.date(2000, 2, 29),), (dt.date(2000, 3, 1),), (dt.date(2001, 3, 1),), (dt.date(2001, 12, 31),)], "d date")
    assert [r[0] for r in rows.select(C.stable_day(F.col("d"))).collect()] == [60, 61, 61, 366]
    assert climatology.calendar(spark).count() == 366


def test_finite_guards_comparisons(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(C.finite(F.col("x"))).collect()] == [None, None, 1.0, None]


def test_weighted_quantiles(spark):
    rows = [("equal", i, 0, float(v), 1.0) for i, v in enumerate((1, 2, 3, 4))] + [("heavy", i, 0, float(v), w) for i, (v, w) in enumerate(zip((1, 2, 3, 4), (1.0, 1.0, 1.0, 7.0), strict=True))] + [("one", 0, 0, 5.0, 2.0), ("none", 0, 0, None, 1.0)]
    got = {r["g"]: (r["m"], r["low"], r["high"]) for r in S.weighted_quantiles(spark.createDataFrame(rows, "g string, row int, col int, v double, w double"), ["g"], "v", "w", {"m": 0.5, "low": 0.0, "high": 1.0}).collect()}
    assert got["equal"] == (2.5, 1.0, 4.0) and got["one"] == (5.0, 5.0, 5.0) and "none" not in got
    positions, values = (np.cumsum([1, 1, 1, 7]) - np.array([1, 1, 1, 7]) / 2) / 10, [1, 2, 3, 4]
    assert math.isclose(got["heavy"][0], np.interp(0.5, positions, values))


def test_adjacency_counts_and_moran(spark):
    small = grid(spark, [[[1, 2], [3, 4]]])
    assert patches.adjacency(small, "rook").count() == 8 and patches.adjacency(small, "queen").count() == 12
    clustered = [[1, 1, -1, -1]] * 4
    checker = [[(-1) ** (i + j) for j in range(4)] for i in range(4)]
    got = [r["moran_i_rook"] for r in spatial.moran(grid(spark, [clustered, checker, [[2] * 4] * 4]), "rook").orderBy("date").collect()]
    assert got[0] > 0.5 and math.isclose(got[1], -1.0) and got[2] is None


def test_diagonal_cells_are_two_rook_patches_or_one_queen_patch(spark):
    cells = grid(spark, [[[5, 0], [0, 5]]])
    for kind, n in (("rook", 2), ("queen", 1)):
        rule = patches.PatchRule(threshold=2.0, connectivity=kind, minimum_cells=1)
        assert patches.detected(cells, rule).agg(F.max("patch_id")).first()[0] == n


def test_labels_against_flood_fill():
    rng = np.random.default_rng(0)
    for kind in ("rook", "queen"):
        mask = rng.random((15, 17)) < 0.5
        row, col = np.nonzero(mask)
        got = patches.least_labels(row, col, kind)
        seen, at = {}, {(r, c): k for k, (r, c) in enumerate(zip(row, col, strict=True))}
        for k, start in enumerate(zip(row, col, strict=True)):
            if start in seen:
                continue
            stack = [start]
            while stack:
                r, c = stack.pop()
                if (r, c) in at and (r, c) not in seen:
                    seen[r, c] = k
                    stack += [(r + a, c + b) for a, b in patches.neighbours(kind)]
        assert got.tolist() == [seen[x] for x in zip(row, col, strict=True)]


def test_patch_filters_and_zero_patch_dates(spark):
    cells = grid(spark, [[[5, 5, 0], [5, 5, 0], [0, 0, 5]], [[0] * 3] * 3])
    rule = patches.PatchRule(threshold=2.0, connectivity="rook", minimum_cells=2)
    table = patches.patch_table(cells, rule)
    row = table.collect()
    assert len(row) == 1 and len(table.columns) == 45 and row[0]["cell_count"] == 4 and row[0]["edge_cell_fraction"] == 1.0
    area = sum(C.EARTH_RADIUS_KM**2 * abs(math.sin(math.radians(i + 0.5)) - math.sin(math.radians(i - 0.5))) * math.radians(1) for i in (0, 0, 1, 1))
    assert math.isclose(row[0]["area_km2"], area, rel_tol=1e-12)
    summary = patches.daily_summary(cells, table, rule).orderBy("date").collect()
    assert [(r["patch_count"], r["status"]) for r in summary] == [(1, "valid"), (0, "not_calculated")] and summary[1]["total_patch_area_km2"] == 0.0


def machine(series, rule):
    """Event membership by walking through the days."""
    found, hits, pending, members, last = [], [], [], [], None

    def close():
        nonlocal hits, pending, members
        if members and len(members) >= rule.minimum_duration:
            found.append(members)
        hits, pending, members = [], [], []

    for i, (date, value, cover) in enumerate(series):
        if last is not None and (date - last).days > rule.maximum_calendar_gap:
            close()
        last = date
        if value is None or cover < rule.minimum_coverage:
            close()
        elif value >= 1.0:
            members = members + pending + [i]
            pending = []
        elif members:
            pending.append(i)
            if len(pending) > rule.allowed_gap:
                close()
    close()
    return {i: k for k, m in enumerate(found, 1) for i in m}


@pytest.mark.parametrize("gap,least,calendar", [(0, 1, 1), (1, 2, 2), (2, 3, 1), (3, 5, 2)])
def test_events_against_a_state_machine(spark, gap, least, calendar):
    rng = random.Random(gap)
    rule = events.EventRule(minimum_duration=least, allowed_gap=gap, maximum_calendar_gap=calendar)
    rows, expected = [], {}
    for k in range(30):
        day, own = DAY, []
        for _ in range(50):
            day += dt.timedelta(rng.choice([1, 1, 1, 1, 2, 3]))
            own.append((day, rng.choice([0.5, 0.9, 1.0, 1.5, 2.0, None]), rng.choice([1.0, 1.0, 1.0, 0.5])))
        rows += [(k, *x) for x in own]
        member = machine(own, rule)
        expected |= {(k, d): member.get(i) for i, (d, _, _) in enumerate(own)}
    df = spark.createDataFrame(rows, "k int, date date, value double, valid_coverage double")
    flags = events.daily_flags(events.fixed_threshold(df, 1.0), rule, ["k"])
    assert {(r["k"], r["date"]): r["event"] for r in flags.collect()} == expected


def test_event_metrics_of_one_event(spark):
    values = [1.0, 3.0, 2.0, 5.0, 2.5]
    df = spark.createDataFrame(list(zip(days(5), values, strict=True)), "date date, value double")
    flags = events.daily_flags(events.fixed_threshold(events.prepared(df), 2.0), events.EventRule(minimum_duration=2))
    row = events.event_metrics(flags, {"strong": 1.0, "extreme": 2.0}).collect()[0]
    assert (row["start_date"], row["peak_date"], row["end_date"]) == (days(5)[1], days(5)[3], days(5)[4])
    assert row["maximum_intensity"] == 3.0 and row["severity_class"] == "extreme" and row["number_of_turning_points"] == 2 and row["onset_rate"] == 1.0 and row["decline_rate"] == 2.5


def test_duplicate_dates(spark):
    df = spark.createDataFrame([(DAY, 1.0, 1), (DAY, 3.0, 2)], "date date, value double, ordinal int")
    for policy, value in (("mean", 2.0), ("first", 1.0), ("last", 3.0)):
        assert events.prepared(df, duplicates=policy).first()["value"] == value
    with pytest.raises(Exception, match="more than once"):
        events.prepared(df).collect()


def test_trend_and_spectrum(spark):
    line = [("m", d, 3 + 2.0 * i) for i, d in enumerate(days(10))]
    wave = [("s", d, math.sin(2 * math.pi * i / 10)) for i, d in enumerate(days(60))]
    rows = spark.createDataFrame(line + wave, "metric string, date date, value double")
    out = temporal.feature_table(rows, windows=(10, 60)).where("status = 'valid'")
    get = {(r["source_metric"], r["window_days"], r["analysis_end_date"], r["metric"]): r["value"] for r in out.collect()}
    end = days(10)[-1]
    assert math.isclose(get["m", 10, end, "ols_slope"], 2) and math.isclose(get["m", 10, end, "theil_sen_slope"], 2) and math.isclose(get["m", 10, end, "mann_kendall_tau"], 1)
    assert get["m", 10, end, "theil_sen_ci_lower"] == get["m", 10, end, "theil_sen_ci_upper"] == 2
    assert math.isclose(get["s", 60, days(60)[-1], "dominant_period"], 10) and get["s", 60, days(60)[-1], "low_frequency_power_fraction"] > 0.99
    names = {r["metric"] for r in temporal.feature_table(rows, windows=(10,)).collect()}
    assert names == {n for f in temporal.FAMILIES.values() for n in f} and len(names) == 48


def test_gaps_are_not_bridged(spark):
    dates = [dt.date(2020, 1, d) for d in (1, 2, 4, 5, 6)]
    rows = spark.createDataFrame([("m", d, v) for d, v in zip(dates, (0.0, 1.0, 100.0, 101.0, 102.0), strict=True)], "metric string, date date, value double")
    row = temporal.simple_features(temporal.windowed(rows, (7,))).where(F.col("end") == dates[-1]).first()
    assert row["mean_absolute_successive_change"] == 1.0 and row["maximum_absolute_jump"] == 1.0 and row["pairs"] == 3


def test_best_assignment_against_all_permutations():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (3, 6)):
        score = rng.random((n, m)) + 1e-6
        left, right = (x.ravel() for x in np.indices((n, m)))
        chosen = tracks.best_assignment(left, right, score.ravel())
        assert len(set(left[chosen])) == len(set(right[chosen])) == len(chosen)
        short, long = (n, m) if n <= m else (m, n)
        table = score if n <= m else score.T
        assert math.isclose(score.ravel()[chosen].sum(), max(sum(table[i, p[i]] for i in range(short)) for p in itertools.permutations(range(long), short)))


def test_best_assignment_of_sparse_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        some = rng.random((n, m)) < 0.4
        left, right = np.nonzero(some)
        score = rng.random(len(left)) + 1e-6
        chosen = tracks.best_assignment(left, right, score)
        assert len(set(left[chosen])) == len(set(right[chosen])) == len(chosen)
        dense = np.zeros((max(n, m), max(n, m)))
        dense[left, right] = score
        best = max(sum(dense[i, p[i]] for i in range(len(dense))) for p in itertools.permutations(range(len(dense))))
        assert math.isclose(score[chosen].sum(), best, abs_tol=1e-12)
    assert tracks.best_assignment(np.zeros(0, int), np.zeros(0, int), np.zeros(0)) == []


def test_labels_over_tiles_are_those_of_the_whole_grid(spark):
    rng = np.random.default_rng(5)
    rows = [(d, int(r), int(c)) for d in ("a", "b") for r, c in zip(*np.nonzero(rng.random((40, 50)) < 0.55), strict=True)]
    # a spiral over all tiles, and cells of another sign that only touch it
    rows += [("c", r, c) for r in range(0, 40, 4) for c in range(50)] + [("c", r, 49 if r // 4 % 2 else 0) for r in range(36) if r % 4]
    df = spark.createDataFrame(rows, "date string, row int, col int").repartition(3)
    for kind in ("rook", "queen"):
        whole = {(r["date"], r["row"], r["col"]): r["label"] for r in patches.labelled(df, kind).collect()}
        for tile in (1, 7, 16):
            assert {(r["date"], r["row"], r["col"]): r["label"] for r in patches.labelled(df, kind, tile=tile).collect()} == whole
        assert {k[0]: v for k, v in whole.items()}["c"] == 0 and len({v for k, v in whole.items() if k[0] == "c"}) == 1
        assert all(label <= (r << 32 | c) for (_, r, c), label in whole.items())


def test_places_among_all_rows(spark):
    from isobath.operators.graph import ranked

    values = [(k * 7919) % 1000 for k in range(1000)]
    out = ranked(spark.createDataFrame([(v, -v % 3) for v in values], "v int, w int").repartition(5), ["w", "v"], "place")
    got = [(r["w"], r["v"]) for r in sorted(out.collect(), key=lambda r: r["place"])]
    assert got == sorted(got) and sorted(r["place"] for r in out.collect()) == list(range(1, 1001))
    assert ranked(spark.createDataFrame([], "v int, w int"), ["v"], "place").count() == 0


def lineage_of(spark, fields):
    cells = grid(spark, fields, -4.0, -90.0)
    rule = patches.PatchRule(threshold=2.0, connectivity="rook", minimum_cells=1)
    found = patches.detected(cells, rule)
    table = patches.patch_table(cells, rule, found)
    return tracks.lineage(table, tracks.links(found, table, tracks.TrackRule()))


def test_split_and_merge(spark):
    whole, two = [[5] * 5, [0] * 5], [[5, 5, 0, 5, 5], [0] * 5]
    nodes, edges = lineage_of(spark, [whole, two, whole])
    kinds = {(r["date"], r["local_patch_id"]): r["node_event_type"] for r in nodes.collect()}
    assert kinds == {(days(3)[0], 1): "split_parent", (days(3)[1], 1): "complex_branch", (days(3)[1], 2): "complex_branch", (days(3)[2], 1): "merge_child"}
    assert sorted(r["lineage_relation"] for r in edges.collect()) == ["merge", "merge", "split", "split"]
    assert edges.where("is_continuation_backbone").count() == 2 and nodes.select("event_family_id").distinct().count() == 1 and nodes.select("track_id").distinct().count() == 4
    assert tracks.lineage_problems(nodes, edges).collect() == []


def test_moving_patch_is_one_track(spark):
    fields = [[[0] * i + [5, 5, 5] + [0] * (5 - i)] for i in range(4)]
    nodes, _ = lineage_of(spark, fields)
    row = tracks.track_metrics(nodes).collect()
    assert len(row) == 1 and row[0]["observed_days"] == 4 and row[0]["start_event_type"] == "appearance" and row[0]["end_event_type"] == "termination"
    assert math.isclose(row[0]["trajectory_tortuosity"], 1.0, rel_tol=1e-3) and len(tracks.track_metrics(nodes).columns) == 50
    family = tracks.family_metrics(nodes)
    assert len(family.columns) == 36 and family.first()["track_count"] == 1


def test_components_are_independent_of_order(spark):
    pairs = [("a", "b"), ("c", "d"), ("b", "e"), ("x", "y"), ("e", "f"), ("f", "g")]
    for seed in range(2):
        random.Random(seed).shuffle(pairs)
        got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
        assert got == dict.fromkeys("abefg", "a") | dict.fromkeys("cd", "c") | dict.fromkeys("xy", "x")


def test_classes_follow_the_order_of_rules(spark):
    rule = spatial.ClassRule()
    fields = [[[2.0] * 4] * 4, [[3.0, -2.0, 3.0, 1.0]] * 4, [[1.0, -1.0, 1.0, -1.0]] * 4, [[0.01] * 4] * 4, [[None] * 4] * 4]
    got = [r["class"] for r in spatial.classified(spatial.class_inputs(grid(spark, fields), rule), rule).orderBy("date").collect()]
    assert got == ["strong_coherent", "strong_heterogeneous", "compensated_mixed", "weak_homogeneous", "insufficient_coverage"]


def test_block_means_of_a_constant_field(spark):
    out = regional.block_means(grid(spark, [[[20.0] * 6] * 6]), 5).collect()
    assert len(out) == 4 and all(math.isclose(r["value"], 20.0) and r["valid_coverage"] == 1.0 for r in out)


def test_quality_report(spark):
    cells = grid(spark, [[[1, 2], [3, 4]], [[5, 5], [5, 5]], [[None, None], [None, None]]])
    row = quality.report(cells).first()
    assert row["constant_field_dates"] == 1 and row["all_nan_dates"] == 1 and row["overall_status"] == "warning"
    assert quality.report(cells.withColumn("value", F.lit(float("inf")))).first()["overall_status"] == "invalid"


def test_units_and_longitudes(spark):
    df = spark.createDataFrame([(DAY, 1.0, 359.5, 290.0), (DAY, 1.0, 0.5, 291.0)], "time date, latitude double, longitude double, thetao double")
    got = cell_sources.normalised(df).collect()
    assert [round(r["value"], 6) for r in got] == [16.85, 17.85] and [r["lon"] for r in got] == [-0.5, 0.5]
    with pytest.raises(ValueError, match="none of"):
        cell_sources.find_variable(df.drop("thetao"))


def test_tiles_cover_the_grid_once():
    for rows, columns, target in ((7, 9, 10), (1, 1, 1), (50, 33, 200), (5, 100, 30)):
        seen = set()
        for a, b, c, d in climatology.tiles(rows, columns, target):
            own = {(i, j) for i in range(a, b) for j in range(c, d)}
            assert len(own) <= target and not own & seen
            seen |= own
        assert len(seen) == rows * columns


def test_prohibited_claims_and_negation(spark):
    rows = [(1, "We predict a warm year."), (2, "This does not predict anything."), (3, "Causado por el viento"), (4, "See https://x.org"), (5, "Plain text")]
    got = {(r["text_id"], r["category"]) for r in facts.prohibited_claims(spark.createDataFrame(rows, "text_id int, text string")).collect()}
    assert got == {(1, "forecast"), (3, "causal_attribution"), (4, "external_reference")}


def test_segments_break_at_gaps_and_missing_values(spark):
    rows = list(zip([DAY, *days(4)[1:2], dt.date(2024, 1, 5), dt.date(2024, 1, 6), dt.date(2024, 1, 7)], [1.0, 2.0, 3.0, None, 4.0], strict=True))
    got = [r["segment_id"] for r in overview.temporal_segments(spark.createDataFrame(rows, "date date, value double"), ["value"]).orderBy("date").collect()]
    assert got == [0, 0, 1, 2, 3]


def test_bundle_appears_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    sinks.publish({"a": spark.range(3), "b": spark.range(2)}, folder)
    assert spark.read.parquet(f"{folder}/a").count() == 3
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.publish({"a": spark.range(9), "b": broken}, folder)
    assert spark.read.parquet(f"{folder}/a").count() == 3


def test_strict_json(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([(float("nan"), 1.5), (float("inf"), None)], "a double, b double"), str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(map(str, lines)) == sorted(map(str, [{"a": None, "b": 1.5}, {"a": None, "b": None}]))


def test_checkpoints_resume(spark, tmp_path):
    manifest = sinks.resumable(spark, {2000: spark.range(5)}, str(tmp_path), {})
    assert sinks.checkpoint_valid(spark, f"{tmp_path}/year=2000", manifest[2000]) and not sinks.checkpoint_valid(spark, f"{tmp_path}/year=2001", manifest[2000])


def test_streaming_runs_continue_over_batches(spark, tmp_path):
    from isobath.streaming import daily

    source, out = tmp_path / "in", []
    rows = [("s", d, v) for d, v in zip(days(6), (0.0, 2.0, 3.0, 2.5, 0.0, 4.0), strict=True)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "series string, date date, value double").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("series string, date date, value double").parquet(str(source))
        query = daily.exceedance_runs(stream, 1.0).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    closed = [(r["start"], r["end"], r["days"], r["maximum"]) for r in out if not r["open"]]
    assert closed == [(days(6)[1], days(6)[3], 3, 3.0)] and sum(r["open"] for r in out) == 2


def test_number_tokens_against_a_plain_pattern(spark):
    import re

    from isobath.plans.features import number_tokens

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = [(i, k, m[0]) for i, t in docs.items() for k, m in enumerate(re.finditer(r"(?<![A-Za-z0-9_])[-+]?[0-9]+(?:[.,][0-9]+)?(?: *%)?", t))]
    assert sorted((r["text_id"], r["position"], r["token"]) for r in number_tokens(spark, sf).collect()) == sorted(expected)


def test_all_temporal_features_of_one_window_by_hand(spark):
    rng = random.Random(11)
    dates = [d for d in days(40) if rng.random() < 0.8]
    values = [round(rng.gauss(0, 2), 3) for _ in dates]
    rows = spark.createDataFrame([("m", d, v) for d, v in zip(dates, values, strict=True)], "metric string, date date, value double")
    got = {r["metric"]: r["value"] for r in temporal.feature_table(rows, windows=(40,)).where(F.col("analysis_end_date") == dates[-1]).collect()}
    v, gaps = np.array(values), np.diff([d.toordinal() for d in dates])
    one = gaps == 1
    step = np.diff(v)
    expected = {
        "mean": v.mean(), "p10": np.quantile(v, 0.1), "mad": np.median(abs(v - np.median(v))), "rmssd": math.sqrt((step[one] ** 2).mean()), "sign_change_count": sum(o and a * b < 0 for o, a, b in zip(one, v, v[1:], strict=False)),
        "turning_point_count": sum(one[:-1] & one[1:] & (step[:-1] * step[1:] < 0)), "lag1_autocorrelation": np.corrcoef(v[:-1][one], v[1:][one])[0, 1], "state_transition_count": sum(one & ((v[1:] > 0) != (v[:-1] > 0))),
        "theil_sen_slope": np.median([(v[j] - v[i]) / (dates[j] - dates[i]).days for i in range(len(v)) for j in range(i + 1, len(v))]),
    }
    for name, value in expected.items():
        assert math.isclose(got[name], value, rel_tol=1e-9), name
