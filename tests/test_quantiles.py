import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.functions import statistics as S
from isobath.operators import events


def values(n, seed=1):
    rng = random.Random(seed)
    kinds = (lambda: rng.gauss(20, 3), lambda: rng.gauss(0, 1), lambda: 0.0, lambda: -1e-300, lambda: rng.choice([1e200, -1e200, 5e-324]), lambda: float(rng.randint(-3, 3)))
    return [rng.choice(kinds)() for _ in range(n)]


def midpoint(rows, q):
    """rows: (value, row, col, weight) in order; interpolation between the midpoints of the cumulated weight."""
    rows = sorted(rows)
    total, so_far, points = math.fsum(r[3] for r in rows), 0.0, []
    for v, _, _, w in rows:
        points.append(((so_far + w / 2) / total, v))
        so_far += w
    low, high = [x for x in points if x[0] <= q], [x for x in points if x[0] > q]
    if not low or not high:
        return (high or low[::-1])[0][1]
    (p, v), (r, u) = low[-1], high[0]
    return v + (u - v) * (q - p) / (r - p)


def test_shares_never_fall(spark):
    vs = sorted(values(3000))
    shares = [r["s"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(vs)], "k int, v double").select("k", S.share_of(F.col("v")).alias("s")).orderBy("k").collect()]
    assert shares == sorted(shares) and len(set(shares)) > 100


def test_weighted_quantiles_of_a_group_over_many_shares(spark):
    rng = random.Random(2)
    rows = [("big" if k % 50 else "small", k // 100, k % 100, v, rng.choice([0.5, 1.0, 2.5])) for k, v in enumerate(values(20_000))]
    df = spark.createDataFrame(rows, "g string, row int, col int, v double, w double").repartition(7)
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["g"]: r for r in S.weighted_quantiles(df, ["g"], "v", "w", qs).collect()}
    for g in ("big", "small"):
        own = [(v, r, c, w) for k, r, c, v, w in rows if k == g]
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(midpoint(own, q), rel=1e-9, abs=1e-12)


def test_percentiles(spark):
    vs = values(5001, 3)
    df = spark.createDataFrame([("x", v) for v in vs] + [("x", None), ("y", 4.0)], "g string, v double").repartition(5)
    got = {r["g"]: r for r in S.percentiles(df, ["g"], "v", {"a": 0.0, "b": 0.333, "c": 0.5, "d": 1.0}).collect()}
    for name, q in (("a", 0), ("b", 0.333), ("c", 0.5), ("d", 1)):
        assert got["x"][name] == pytest.approx(np.quantile(vs, q), rel=1e-9, abs=1e-12) and got["y"][name] == 4.0


def test_percentile_threshold_of_all_rows(spark):
    df = spark.createDataFrame([(k, float(k * k)) for k in range(101)], "k int, value double")
    out = events.percentile_threshold(df, 90.0)
    assert out.columns == ["k", "value", "threshold"] and {r["threshold"] for r in out.collect()} == {8100.0}
    empty = events.percentile_threshold(df.where("k < 0").unionByName(spark.createDataFrame([(1, None)], "k int, value double")), 90.0)
    assert empty.first()["threshold"] is None
