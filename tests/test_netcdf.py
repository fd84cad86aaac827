import datetime
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.sources import netcdf as N


@pytest.fixture
def session(spark):
    spark.dataSource.register(N.NetcdfSource)
    return spark


def cells(spark, days=20):
    rows = [(datetime.date(2020, 1, 1) + datetime.timedelta(days=2 * d), -1.5 + r, 179.0 + c, None if (d + r + c) % 7 == 0 else d + r / 10 + c / 100, float(c)) for d in range(days) for r in range(4) for c in range(3) if (d, r) != (3, 2)]
    return spark.createDataFrame(rows, "date date, lat double, lon double, sst double, ice double")


def test_round_trip(session, tmp_path):
    df = cells(session)
    N.by_date(df, 3).write.format("isobath-netcdf").option("units", "degree_Celsius").mode("append").save(f"{tmp_path}/cube")
    assert 1 < len(os.listdir(tmp_path / "cube")) <= 3 and all(n.endswith(".nc") for n in os.listdir(tmp_path / "cube"))
    back = session.read.format("isobath-netcdf").load(f"{tmp_path}/cube")
    assert back.columns == ["date", "lat", "lon", "sst", "ice"]
    key = lambda r: tuple(r)[:3]
    wanted, got = sorted(map(tuple, df.collect())), sorted(map(tuple, back.collect()), key=key)
    # a cell without a row comes back without values
    assert [r for r in got if r[3] is not None or r[4] is not None] == sorted(wanted, key=key) and len(got) == len(wanted) + 3
    N.by_date(df.where("date < '2020-01-05'"), 2).write.format("isobath-netcdf").mode("overwrite").save(f"{tmp_path}/cube")
    assert session.read.format("isobath-netcdf").load(f"{tmp_path}/cube").select("date").distinct().count() == 2


def test_only_wanted_records_are_read(session, tmp_path):
    N.by_date(cells(session), 1).write.format("isobath-netcdf").mode("append").save(f"{tmp_path}/cube")
    reader = lambda **o: N.PushedReader(N.StructType.fromDDL("date date, lat double, lon double, sst double"), {"path": f"{tmp_path}/cube", "records": "4", **o})
    assert [(p.first, p.last) for p in reader().partitions()] == [(0, 4), (4, 8), (8, 12), (12, 16), (16, 20)]
    assert [(p.first, p.last) for p in reader(start="2020-01-05", end="2020-01-16").partitions()] == [(2, 6), (6, 8)]
    pushed = reader()
    kept = list(pushed.pushFilters([N.GreaterThan(("date",), datetime.date(2020, 1, 5)), N.LessThanOrEqual(("date",), datetime.date(2020, 1, 9)), N.EqualTo(("lat",), 1.0)]))
    assert len(kept) == 3 and [(p.first, p.last) for p in pushed.partitions()] == [(3, 5)]
    got = session.read.format("isobath-netcdf").option("start", "2020-01-05").option("end", "2020-01-05").load(f"{tmp_path}/cube").where("sst > 0")
    assert {r["date"] for r in got.collect()} == {datetime.date(2020, 1, 5)}
    setting = "spark.sql.python.filterPushdown.enabled"
    session.conf.set(setting, "true")
    try:
        got = session.read.format("isobath-netcdf").option("pushdown", "true").load(f"{tmp_path}/cube").where("date >= DATE '2020-02-01' AND sst > 0")
        assert {r["date"] for r in got.collect()} == {datetime.date(2020, 2, d) for d in (2, 4, 6, 8)}
    finally:
        session.conf.unset(setting)


def foreign(kind, packed=True):
    """A file as other tools write it: int16 values with scale, offset and fill, hours since a date, descending latitudes."""
    lat, lon, hours = [2.0, 1.0], [10.0, 11.0, 12.0], [0, 24, 36, 72]
    count, off = (">q", ">q") if kind == 5 else (">i", ">q" if kind == 2 else ">i")
    n = lambda x: struct.pack(count, x)
    text = lambda s: n(len(s)) + s.encode().ljust(N.padded(len(s)), b"\0")
    i4 = lambda x: struct.pack(">i", x)
    chars = lambda k, v: text(k) + i4(2) + text(v)
    number = lambda k, t, f, v: text(k) + i4(t) + n(1) + struct.pack(f, v).ljust(N.padded(struct.calcsize(f)), b"\0")
    values = np.arange(4 * 2 * 3).reshape(4, 2, 3).astype(">i2")
    values[1, 1, 2] = -999

    def head(begins):
        var = lambda name, dims, notes, t, size, b: text(name) + n(len(dims)) + b"".join(n(d) for d in dims) + i4(12) + n(len(notes)) + b"".join(notes) + i4(t) + n(size) + struct.pack(off, b)
        out = b"CDF" + bytes([kind]) + n(len(hours)) + i4(10) + n(3) + text("time") + n(0) + text("latitude") + n(2) + text("longitude") + n(3) + i4(12) + n(1) + chars("title", "x")
        return out + i4(11) + n(4) + var("time", [0], [chars("units", "hours since 1999-12-31 12:00:00")], 4, 4, begins[0]) + var("latitude", [1], [], 5, 8, begins[1]) + var("longitude", [2], [], 5, 12, begins[2]) + var("sst", [0, 1, 2], [number("scale_factor", 6, ">d", 0.5), number("add_offset", 6, ">d", 10.0), number("_FillValue", 3, ">h", -999)], 3, 12, begins[3])

    at = len(head([0] * 4))
    begins = [at + 20, at, at + 8, at + 24]
    records = b"".join(struct.pack(">i", h) + v.tobytes() for h, v in zip(hours, values, strict=True))
    return head(begins) + np.array(lat, ">f4").tobytes() + np.array(lon, ">f4").tobytes() + records, values


@pytest.mark.parametrize("kind", [1, 2, 5])
def test_files_of_other_tools(session, tmp_path, kind):
    data, values = foreign(kind)
    (tmp_path / "a.nc").write_bytes(data)
    got = {(str(r["date"]), r["lat"], r["lon"]): r["sst"] for r in session.read.format("isobath-netcdf").load(f"{tmp_path}/a.nc").collect()}
    dates = ["1999-12-31", "2000-01-01", "2000-01-02", "2000-01-03"]  # noon, noon, midnight, noon
    wanted = {(d, la, lo): None if values[k, i, j] == -999 else values[k, i, j] * 0.5 + 10 for k, d in enumerate(dates) for i, la in enumerate((2.0, 1.0)) for j, lo in enumerate((10.0, 11.0, 12.0))}
    assert got == wanted


def test_what_is_no_cube_is_refused(session, tmp_path):
    (tmp_path / "a.nc").write_bytes(b"HDF5 not this")
    with pytest.raises(Exception, match="no classic NetCDF"):
        session.read.format("isobath-netcdf").load(f"{tmp_path}/a.nc").collect()
    (tmp_path / "b.nc").write_bytes(foreign(1)[0][:100])
    with pytest.raises(Exception, match="ends within its header"):
        session.read.format("isobath-netcdf").load(f"{tmp_path}/b.nc").collect()


def test_a_failed_write_leaves_nothing(session, tmp_path):
    bad = cells(session).withColumn("sst", F.when(F.col("date") == "2020-01-21", F.raise_error(F.lit("spoiled"))).otherwise(F.col("sst")).cast("double"))
    with pytest.raises(Exception, match="spoiled"):
        N.by_date(bad, 3).write.format("isobath-netcdf").mode("append").save(f"{tmp_path}/cube")
    assert not (tmp_path / "cube").exists() or os.listdir(tmp_path / "cube") == []
