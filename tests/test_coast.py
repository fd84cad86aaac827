import numpy as np
import pytest

from isobath.operators import coast

R = 6371.0088


def vec(lat, lon):
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)


def sampled(point, arcs, n=20001):
    """Least distance from points on the arcs, a fine step apart."""
    best = np.inf
    for la, oa, lb, ob in arcs:
        a, b = vec(la, oa), vec(lb, ob)
        w = np.arccos(np.clip(a @ b, -1, 1))
        s = np.linspace(0, 1, n)[:, None]
        on = (np.sin((1 - s) * w) * a + np.sin(s * w) * b) / np.sin(w)
        best = min(best, 2 * R * np.arcsin(np.linalg.norm(on - vec(*point), axis=1).min() / 2))
    return best


@pytest.mark.parametrize(
    "arcs",
    [
        [(0, -80, 0.5, -79), (0.5, -79, -5, -81)],
        [(10, 179, 12, -178), (12, -178, -20, 175)],
        [(88, 0, 88, 120), (88, 120, 89.9, -60)],
        [(-60, 10, 40, 80)],
        [(5, 5, 5, 5.000001)],
    ],
)
def test_distance_from_arcs(spark, arcs):
    rng = np.random.default_rng(7)
    points = []
    for la, oa, lb, ob in arcs:
        a, b = vec(la, oa), vec(lb, ob)
        for s in np.linspace(0, 1, 30):
            p = a * (1 - s) + b * s + rng.normal(size=3) * 0.015
            p /= np.linalg.norm(p)
            points.append((float(np.degrees(np.arcsin(p[2]))), float(np.degrees(np.arctan2(p[1], p[0])))))
    points += [(0.0, 0.0), (90.0, 0.0), (-90.0, 12.0), (45.0, -170.0)]
    df = spark.createDataFrame(points, "lat double, lon double")
    rows = spark.createDataFrame([tuple(map(float, a)) for a in arcs], "lat_a double, lon_a double, lat_b double, lon_b double")
    for limit in (40.0, 111.12, 400.0):
        got = {(r["lat"], r["lon"]): r["coast_km"] for r in coast.coast_distance(df, rows, limit).collect()}
        for p in points:
            d = sampled(p, arcs)
            if d < limit - 0.1:
                assert got[p] == pytest.approx(d, abs=0.1)
            elif d > limit + 0.1:
                assert p not in got


def test_vertices_become_arcs_and_limits_are_checked(spark):
    v = spark.createDataFrame([(1, 2, 1.0, 1.0), (1, 1, 0.0, 0.0), (2, 1, 5.0, 5.0), (1, 3, 2.0, 0.0)], "line int, place int, lat double, lon double")
    assert sorted(map(tuple, coast.arcs(v).collect())) == [(1, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 2.0, 0.0)]
    with pytest.raises(ValueError):
        coast.coast_distance(v, coast.arcs(v), 0)
    assert coast.coast_distance(v, coast.arcs(v).limit(0)).count() == 0
