import datetime
import math
import statistics

import pytest
from pyspark.sql import functions as F

from isobath.operators import temporal
from isobath.plans import features

DAYS = [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(45) if k != 20]
VALUES = [3 + math.sin(k * 1.7) + (k % 5) / 4 for k in range(len(DAYS))]


@pytest.fixture
def series(spark):
    return spark.createDataFrame([("m", d, v if k != 7 else None) for k, (d, v) in enumerate(zip(DAYS, VALUES, strict=True))], "metric string, date date, value double")


def test_all_is_the_window_from_the_first_date_on(series):
    found = temporal.feature_table(series, windows=("all", 10, 45)).where(F.col("analysis_end_date").isin(DAYS[-1], DAYS[9])).collect()
    for end, days in ((DAYS[-1], 45), (DAYS[9], 10)):
        both = sorted((r.asDict() for r in found if r["analysis_end_date"] == end and r["window_days"] == days), key=lambda r: r["metric"])
        assert len(both) == 96
        for x, y in zip(both[::2], both[1::2], strict=True):
            v, w = x.pop("value"), y.pop("value")
            assert x == y and (v is w is None or v == pytest.approx(w, rel=1e-9, abs=1e-9))


def test_coefficient_of_variation_is_opt_in(series):
    mine = lambda **how: temporal.feature_table(series, windows=("all",), **how).where((F.col("analysis_end_date") == DAYS[-1]) & (F.col("metric") == "coefficient_of_variation")).first()
    values = [v for k, v in enumerate(VALUES) if k != 7]
    assert mine()["status"] == "not_calculated"
    assert mine(coefficient_of_variation_valid=True)["value"] == pytest.approx(statistics.pstdev(values) / statistics.mean(values))


def test_query_has_every_production_window(monkeypatch, spark, series):
    monkeypatch.setattr(features, "_series", lambda *_: series)
    out = features.temporal_table(spark, "")
    assert out.count() == len(DAYS) * 5 * 48
    assert {7, 15, 30, 90, 1, 45} <= {r["window_days"] for r in out.select("window_days").distinct().collect()}


def test_period_ends_at_the_end_date(series):
    period = (DAYS[10], DAYS[30])
    out = temporal.feature_table(series, windows=(period,)).where("metric = 'mean'").collect()
    got = {r["analysis_end_date"]: r for r in out}
    for k in (5, 12, 25, 44 - 1):
        r, inside = got[DAYS[k]], [v for i, (d, v) in enumerate(zip(DAYS, VALUES, strict=True)) if period[0] <= d <= min(DAYS[k], period[1]) and i != 7]
        assert r["window_start_date"] == period[0] and r["window_end_date"] == min(DAYS[k], period[1]) and r["n_observations"] == len(inside)
        assert r["value"] is None if len(inside) < 5 else r["value"] == pytest.approx(statistics.mean(inside))


def test_only_wanted_dates_are_end_dates(series):
    out = temporal.wide_features(series.withColumn("wanted", F.dayofmonth("date") == 1), windows=(7, "all"))
    assert {r["end"] for r in out.collect()} == {d for d in DAYS if d.day == 1}


def test_series_without_values(spark):
    empty = spark.createDataFrame([("m", DAYS[0], None), ("m", DAYS[1], None)], "metric string, date date, value double")
    assert {r["status"] for r in temporal.feature_table(empty, windows=(7, "all")).collect()} == {"not_calculated"}
    assert temporal.feature_table(empty.limit(0), windows=(7, "all")).count() == 0
