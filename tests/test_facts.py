"""Numbers that texts claim, and cubes that can be told apart."""

import pytest

from isobath.operators import facts as P
from isobath.sources import cells

TEXTS = [
    (1, "On 2026-07-19 the 7-day mean rose by 1.25 in track TRK000012"),
    (2, "Over 1991-2020 the 90th percentile was 1.25 after 3 days"),
    (3, "Entre 5 y 10 el percentil 90 fue 9.99"),
    (4, "It rose by 1.25 and 7.5"),
]


def test_names_claim_nothing(spark):
    texts = spark.createDataFrame(TEXTS, "text_id long, text string")
    cited = spark.createDataFrame([(i, "f") for i, _ in TEXTS], "text_id long, fact_id string")
    known = P.registry(spark.createDataFrame([("f", 1.25, "degC", 2)], "fact_id string, value double, unit string, precision int"))
    got = {}
    for r in P.unsupported_numbers(texts, cited, known).collect():
        got.setdefault(r["text_id"], set()).add(r["number"])
    assert got == {3: {5.0, 10.0, 9.99}, 4: {7.5}}


@pytest.mark.parametrize(("values", "kelvin"), [([290.0, 291.0, 1.0], True), ([20.0, 21.0, 300.0], False), ([20.0, 300.0], True), ([None, 15.0], False)])
def test_units_by_counts_equal_the_median(spark, values, kelvin):
    df = spark.createDataFrame([(v,) for v in values], "sst double")
    assert cells.is_kelvin(df, "sst") is kelvin


def test_unit_that_cannot_be_told(spark):
    with pytest.raises(ValueError, match="unit"):
        cells.is_kelvin(spark.createDataFrame([(100.0,)], "sst double"), "sst")


def test_an_empty_live_cube_gives_way_to_the_demo(spark, tmp_path):
    live, demo = str(tmp_path / "live"), str(tmp_path / "demo")
    spark.createDataFrame([], "sst double").write.parquet(live)
    spark.createDataFrame([(1.0,)], "sst double").write.parquet(demo)
    assert cells.read_live_or_demo(spark, live, demo).first()["data_mode"] == "demo"
    assert cells.read_live_or_demo(spark, demo, live).first()["data_mode"] == "live"
