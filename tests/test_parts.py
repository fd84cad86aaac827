import datetime
import os

import pytest
from pyspark.sql import functions as F

from isobath.sources import parts as P

TILES = [(0, 2, 0, 4), (2, 4, 0, 4)]


def cells(spark, shift=0.0):
    rows = [(datetime.date(y, m, 1), r, c, -2.0 + r, 10.0 + c, None if (r, c, m) == (1, 1, 2) else y + r / 10 + c / 100 + shift) for y in (2001, 2002) for m in (1, 2) for r in range(4) for c in range(4)]
    return spark.createDataFrame(rows, "date date, row int, col int, lat double, lon double, value double")


def rebuilt(df):
    return {(r["tile"], r["year"]) for r in df.where("rebuilt").collect()}


def test_only_stale_parts_are_built(spark, tmp_path):
    folder, all_parts = f"{tmp_path}/x", {(t, y) for t in (0, 1) for y in (2001, 2002)}
    df = cells(spark)
    assert rebuilt(P.build(df, TILES, folder)) == all_parts
    files = {f"{d}/{f}": os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(f"{folder}/data") for f in names}
    assert rebuilt(P.build(df.repartition(5), TILES, folder)) == set()
    # a lost part, a spoiled one, and one whose source has changed
    for name in os.listdir(f"{folder}/data/tile=0/year=2001"):
        os.remove(f"{folder}/data/tile=0/year=2001/{name}")
    bad = P.stored(spark, folder).where("tile = 1 AND year = 2001").withColumn("value", F.col("value") * 2).collect()
    spark.createDataFrame(bad, P.stored(spark, folder).schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*P.KEYS).parquet(f"{folder}/data")
    assert rebuilt(P.build(df, TILES, folder)) == {(0, 2001), (1, 2001)}
    same = {f"{d}/{f}": os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(f"{folder}/data/tile=0/year=2002") for f in names}
    assert same and all(files[f] == t for f, t in same.items())
    back = P.assembled(spark, folder, step=1.0).select(df.columns)
    assert back.exceptAll(df).union(df.exceptAll(back)).isEmpty()
    assert not [n for n in os.listdir(folder) if n.startswith("beside")]


def test_contract(spark, tmp_path):
    folder, df = f"{tmp_path}/x", cells(spark)
    P.build(df, TILES, folder)
    assert len(rebuilt(P.build(df, TILES, folder, unit="kelvin"))) == 4
    assert rebuilt(P.build(df, [(0, 2, 0, 4), (2, 5, 0, 4)], folder, unit="kelvin")) == {(1, 2001), (1, 2002)}


def test_digest_tells_rows_apart(spark):
    a = spark.createDataFrame([(1, 1, 2.0, None), (1, 1, 2.0, None), (1, 1, None, 2.0)], "tile int, year int, x double, y double")
    digest = lambda df: P.digests(df).first()["digest"]
    assert digest(a) == digest(a.select("y", "x", "year", "tile").repartition(3))
    assert digest(a) != digest(a.distinct()) and digest(a) != digest(a.select("tile", "year", F.col("y").alias("x"), F.col("x").alias("y")))


def test_what_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="outside all tiles"):
        P.build(cells(spark), TILES[:1], f"{tmp_path}/x")
    with pytest.raises(ValueError, match="not finite"):
        P.build(cells(spark).withColumn("value", F.lit(float("nan"))), TILES, f"{tmp_path}/x")
    P.build(cells(spark).where("row <> 1"), TILES, f"{tmp_path}/y")
    with pytest.raises(ValueError, match="wider than the resolution"):
        P.assembled(spark, f"{tmp_path}/y", step=1.0)
