import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from isobath.operators import assembly, climatology, patches, regional
from tests.test_operators import grid


def test_spatial_feature_table_has_every_feature(spark):
    fields = [[[1.0 * (i * j % 5) for j in range(5)] for i in range(5)], [[None] * 5] * 5]
    out = assembly.spatial_feature_table(grid(spark, fields), variable="sst", minimum_cells=1).collect()
    assert len(out) == 2 * 34 and {r["status"] for r in out if r["date"] == dt.date(2024, 1, 2) and r["family"] != "coverage"} == {"not_calculated"}
    values = {r["metric"]: r["value"] for r in out if r["date"] == dt.date(2024, 1, 1)}
    assert values["valid_coverage"] == 1.0 and values["patch_count"] >= 1 and values["local_spatial_standard_deviation"] > 0


def test_axes(spark):
    axis = spark.createDataFrame([(0, 359.5), (1, 0.5), (2, 1.5)], "col int, lon double")
    assert [r["lon"] for r in assembly.unwrapped_longitudes(axis).orderBy("col").collect()] == [359.5, 360.5, 361.5]
    edges = assembly.cell_edges(spark.createDataFrame([(89.5,), (88.5,)], "lat double"), "lat").orderBy("lat").collect()
    assert [(r["edge_low"], r["edge_high"]) for r in edges] == [(88.0, 89.0), (89.0, 90.0)]


def test_compatible_climatology(spark):
    cells = grid(spark, [[[20.0, 21.0], [22.0, 23.0]]])
    demo = assembly.demo_climatology(spark, 2, 2)
    assert climatology.violations(demo).collect() == []
    assert regional.compatibility(cells, demo).first()["status"] == "compatible"
    small = demo.where("row = 0")
    found = assembly.first_compatible(cells, [small, demo])
    assert found[0] == 1 and assembly.first_compatible(cells, [small]) is None


def test_build_reuses_checkpoints(spark, tmp_path):
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(i), 0, 0, 0.0, 0.0, math.sin(i / 58)) for i in range(730)]
    cells = spark.createDataFrame(rows, "date date, row int, col int, lat double, lon double, value double")
    clim, manifest = assembly.build_climatology(cells, str(tmp_path))
    assert clim.count() == 366 and sorted(manifest) == [2000, 2001]
    again, same = assembly.build_climatology(cells, str(tmp_path), manifest)
    assert same == manifest and again.exceptAll(clim).isEmpty()
    tiled = assembly.build_tiles(cells, 10)
    assert tiled.count() == 366 and assembly.tile_problems(tiled).isEmpty()


def test_labels_and_table_agree(spark):
    out = assembly.daily_patch_products(grid(spark, [[[5, 5, 0], [0, 0, 5]]]), patches.PatchRule(minimum_cells=1, connectivity="rook"))
    assert assembly.tracking_problems(out["labels"], out["patches"]).isEmpty()
    wrong = out["patches"].where("patch_id = 1").withColumn("area_km2", F.col("area_km2") * 2)
    assert sorted(r["problem"] for r in assembly.tracking_problems(out["labels"], wrong).collect()) == ["areas differ", "not in the table"]


def test_domains(spark, tmp_path):
    path = str(tmp_path / "cube")
    grid(spark, [[[1, 2, 3, 4]] * 4]).write.parquet(path)
    box = regional.Box((-1.0, 2.0), (-1.0, 5.0))
    specs = assembly.registry([assembly.DomainSpec("a", box, 1.0, path), assembly.DomainSpec("b", box, 1.0, str(tmp_path / "none"))])
    out = assembly.load_domains(spark, specs, {"a": 2})
    assert out["b"] == ("unavailable", None) and out["a"][0] == "available" and out["a"][1].count() == 4
    with pytest.raises(ValueError, match="share"):
        assembly.registry([specs["a"], specs["a"]])
    with pytest.raises(FileNotFoundError):
        assembly.load_sources(spark, {"x": (str(tmp_path / "none"), [], True)})
