"""Cubes in the classic NetCDF formats (CDF-1, CDF-2 and CDF-5), read and written as a Spark data source.

``spark.dataSource.register(NetcdfSource)``, then ``spark.read.format("isobath-netcdf").load(path)``:
a file or a folder of files gives the long table ``date, lat, lon`` and one column per variable over
(time, latitude, longitude), in double, unpacked by scale and offset, fill values null.  The header names
the byte range of every record, so a task reads whole records, ``records`` at a time, and those alone whose
dates lie between the options ``start`` and ``end``; with the option ``pushdown`` (and Spark's setting
``spark.sql.python.filterPushdown.enabled``) also only what the query's filters on ``date`` leave.

Writing takes that table, dates of one task to a file: deal rows by date first (``by_date``).  Files are
written under another name and take theirs when all tasks are done; what fails leaves none behind.
Paths may be those of any store that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import datetime
import io
import math
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Type codes of the format and their big-endian numpy types.  Fixed values.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
LATITUDES, LONGITUDES, TIMES = ("lat", "latitude"), ("lon", "longitude"), ("time", "date")
UNITS = re.compile(r"\s*(second|minute|hour|day)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2})[.\d]*)?)?", re.IGNORECASE)
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
FILL = 9.969209968386869e36
EPOCH = datetime.date(1970, 1, 1)


@dataclass
class Variable:
    name: str
    dimensions: list[str]
    attributes: dict
    dtype: str
    begin: int
    record: bool
    count: int
    """Numbers of one record, or of all where there are no records."""

    def size(self) -> int:
        return self.count * np.dtype(self.dtype).itemsize


@dataclass
class Header:
    dimensions: dict[str, int]
    variables: dict[str, Variable]
    records: int
    stride: int


def padded(n: int) -> int:
    return -(-n // 4) * 4


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.file, self.wide = io.BytesIO(data), data[3:4] == b"\x05"
        self.file.seek(4)
        self.offset64 = data[3:4] in (b"\x02", b"\x05")

    def take(self, n: int) -> bytes:
        out = self.file.read(n)
        if len(out) < n:
            raise EOFError
        return out

    def int32(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def size(self) -> int:
        return struct.unpack(">q", self.take(8))[0] if self.wide else self.int32()

    def place(self) -> int:
        return struct.unpack(">q", self.take(8))[0] if self.offset64 else self.int32()

    def name(self) -> str:
        n = self.size()
        return self.take(padded(n))[:n].decode("utf-8")

    def items(self, tag: int) -> range:
        found, n = self.int32(), self.size()
        if found not in (0, tag) or found == 0 and n:
            raise ValueError("no NetCDF header")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.items(ATTRIBUTE):
            name, kind, n = self.name(), TYPES[self.int32()], self.size()
            raw = self.take(padded(n * np.dtype(kind).itemsize))[: n * np.dtype(kind).itemsize]
            out[name] = raw.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(raw, kind)[0] if n else None
        return out


def parsed(data: bytes, file_size: int) -> Header:
    """The header in the first bytes of a file; ``EOFError`` if these don't hold all of it."""
    if data[:3] != b"CDF" or data[3:4] not in (b"\x01", b"\x02", b"\x05"):
        raise ValueError("no classic NetCDF file")
    r = _Reader(data)
    records = r.size()
    sizes = [(r.name(), r.size()) for _ in r.items(DIMENSION)]
    r.attributes()
    variables = []
    for _ in r.items(VARIABLE):
        name = r.name()
        own = [r.size() for _ in range(r.size())]
        attributes, kind = r.attributes(), TYPES[r.int32()]
        r.size()  # of a large variable it is no size, so it is worked out below
        record = bool(own) and sizes[own[0]][1] == 0
        variables.append(Variable(name, [sizes[i][0] for i in own], attributes, kind, r.place(), record, math.prod(sizes[i][1] for i in own[1 if record else 0 :])))
    of_records = [v for v in variables if v.record]
    stride = of_records[0].size() if len(of_records) == 1 else sum(padded(v.size()) for v in of_records)
    if records < 0 and stride:  # a stream that wasn't closed: as many as there are
        records = (file_size - min(v.begin for v in of_records)) // stride
    return Header({n: s or records for n, s in sizes}, {v.name: v for v in variables}, records, stride)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, own = _store(path)
    if store.get_file_info(own).type == fs.FileType.File:
        return [own]
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(own)) if x.path.endswith(".nc") and x.is_file)


class Cube:
    """One open file: its header and its axes."""

    def __init__(self, path: str, own: str) -> None:
        store, _ = _store(path)
        self.file = store.open_input_file(own)
        total, n = self.file.size(), 1 << 16
        while True:
            try:
                self.header = parsed(self.file.read_at(min(n, total), 0), total)
                break
            except EOFError:
                if n >= total:
                    raise ValueError(f"{own} ends within its header") from None
                n *= 4
        named = self.header.variables
        pick = lambda names: next((named[x] for x in names if x in named), None)
        self.lat, self.lon, self.time = pick(LATITUDES), pick(LONGITUDES), pick(TIMES)
        if None in (self.lat, self.lon, self.time):
            raise ValueError(f"{own} has no axes of time, latitude and longitude")
        axes = [self.time.dimensions[0], self.lat.dimensions[0], self.lon.dimensions[0]]
        self.fields = [v for v in named.values() if v.dimensions == axes]

    def values(self, v: Variable, first: int, last: int) -> np.ndarray:
        """Records (or first places of a fixed variable) ``first`` to ``last``, a row each."""
        width = v.size() if v.record else v.size() // max(1, self.header.dimensions[v.dimensions[0]])
        if not v.record:
            return np.frombuffer(self.file.read_at((last - first) * width, v.begin + first * width), v.dtype).reshape(last - first, -1)
        stride = self.header.stride
        raw = self.file.read_at((last - first - 1) * stride + width, v.begin + first * stride)
        return np.stack([np.frombuffer(raw, v.dtype, v.count, k * stride) for k in range(last - first)])

    def whole(self, v: Variable) -> np.ndarray:
        return self.values(v, 0, self.header.dimensions[v.dimensions[0]]).ravel().astype(float)

    def days(self) -> np.ndarray:
        """Days since 1970 of the records."""
        found = UNITS.match(str(self.time.attributes.get("units", "")))
        if not found:
            raise ValueError(f"unknown units of time {self.time.attributes.get('units')!r}")
        if str(self.time.attributes.get("calendar", "standard")).lower() not in ("standard", "gregorian", "proleptic_gregorian"):
            raise ValueError(f"unknown calendar {self.time.attributes['calendar']!r}")
        kind, year, month, day, *clock = found.groups()
        start = (datetime.date(int(year), int(month), int(day)) - EPOCH).days * 86400 + sum(int(c or 0) * s for c, s in zip(clock, (3600, 60, 1), strict=True))
        return np.floor((start + self.whole(self.time) * SECONDS[kind.lower()]) / 86400).astype(np.int64)

    def unpacked(self, v: Variable, first: int, last: int) -> np.ndarray:
        raw = self.values(v, first, last)
        out = raw.astype(float)
        for name in ("_FillValue", "missing_value"):
            if (fill := v.attributes.get(name)) is not None:
                out[raw == fill] = np.nan
        if v.dtype in (">f4", ">f8"):
            out[np.abs(out) >= FILL * 0.999] = np.nan
        return out * float(v.attributes.get("scale_factor", 1)) + float(v.attributes.get("add_offset", 0))


class Records(InputPartition):
    def __init__(self, own: str, first: int, last: int) -> None:
        super().__init__((own, first, last))
        self.own, self.first, self.last = own, first, last


class NetcdfReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.path, self.columns, self.step = options["path"], schema.fieldNames(), int(options.get("records", 32))
        day = lambda text, other: (datetime.date.fromisoformat(text) - EPOCH).days if text else other
        self.low, self.high = day(options.get("start"), -(1 << 40)), day(options.get("end"), 1 << 40)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for own in _files(self.path):
            days = Cube(self.path, own).days()
            wanted = np.flatnonzero((days >= self.low) & (days <= self.high))
            for k in range(0, len(wanted), self.step):
                some = wanted[k : k + self.step]
                # runs of neighbouring records
                for run in np.split(some, np.flatnonzero(np.diff(some) != 1) + 1):
                    out.append(Records(own, int(run[0]), int(run[-1]) + 1))
        return out or [Records("", 0, 0)]

    def read(self, part: Records) -> Iterator:
        import pyarrow as pa

        if part.first == part.last:
            return
        cube = Cube(self.path, part.own)
        lat, lon, days = cube.whole(cube.lat), cube.whole(cube.lon), cube.days()
        fields = {v.name: v for v in cube.fields}
        for k in range(part.first, part.last):
            columns = {"date": pa.array(np.full(len(lat) * len(lon), days[k], np.int32)).cast(pa.date32()), "lat": pa.array(np.repeat(lat, len(lon))), "lon": pa.array(np.tile(lon, len(lat)))}
            for name in set(self.columns) - set(columns):
                values = cube.unpacked(fields[name], k, k + 1).ravel() if name in fields else np.full(len(lat) * len(lon), np.nan)
                columns[name] = pa.array(values, from_pandas=True)
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.columns], names=self.columns)


class PushedReader(NetcdfReader):
    """With filters on ``date`` taken from the query; Spark refuses the method where its setting is off."""

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802  Spark's name
        for f in filters:
            if getattr(f, "attribute", None) == ("date",) and isinstance(getattr(f, "value", None), datetime.date):
                day = (f.value - EPOCH).days
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low = max(self.low, day + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high = min(self.high, day - isinstance(f, LessThan))
            yield f  # Spark tests them again


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class NetcdfWriter(DataSourceWriter):
    """One file per task that has rows; ``units`` and ``fill`` are options."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.path, self.columns, self.units, self.overwrite = options["path"], schema.fieldNames(), options.get("units", ""), overwrite
        self.staged = f"_staged-{uuid.uuid4().hex}"
        if not {"date", "lat", "lon"} < set(self.columns):
            raise ValueError("columns date, lat, lon and at least one variable are needed")

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        store, folder = _store(self.path)
        found: dict[datetime.date, list] = {}
        for row in rows:
            found.setdefault(row["date"], []).append(row)
        if not found:
            return Written(f"{folder}/{self.staged}", [])
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.nc"
        store.create_dir(f"{folder}/{self.staged}", recursive=True)
        with store.open_output_stream(f"{folder}/{self.staged}/{name}") as out:
            out.write(packed(found, [c for c in self.columns if c not in ("date", "lat", "lon")], self.units))
        return Written(f"{folder}/{self.staged}", [name])

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        old = _files(self.path) if self.overwrite and store.get_file_info(folder).type == fs.FileType.Directory else []
        for m in messages:
            for name in m.names if m else []:
                store.move(f"{m.folder}/{name}", f"{folder}/{name}")
        for file in old:
            store.delete_file(file)
        self._clear(store, folder)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, folder: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{folder}/{self.staged}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.staged}")


def packed(days: dict[datetime.date, list], names: list[str], units: str) -> bytes:
    """A CDF-2 file of some days' rows: a record a day, cells without a row or value filled."""
    lat, lon = (sorted({r[c] for rows in days.values() for r in rows}) for c in ("lat", "lon"))
    row, col = {x: k for k, x in enumerate(lat)}, {x: k for k, x in enumerate(lon)}
    text = lambda s: struct.pack(">i", len(s.encode())) + s.encode().ljust(padded(len(s.encode())), b"\0")
    note = lambda name, value: text(name) + (struct.pack(">i", 2) + text(value) if isinstance(value, str) else struct.pack(">iid", 6, 1, value))
    notes = lambda d: struct.pack(">ii", ATTRIBUTE if d else 0, len(d)) + b"".join(note(k, v) for k, v in d.items())
    slab = 8 * len(lat) * len(lon)
    variables = [("time", [0], {"units": "days since 1970-01-01", "calendar": "proleptic_gregorian"}, 8), ("lat", [1], {"units": "degrees_north"}, 8 * len(lat)), ("lon", [2], {"units": "degrees_east"}, 8 * len(lon)), *((n, [0, 1, 2], {"_FillValue": FILL, **({"units": units} if units else {})}, slab) for n in names)]

    def head(begins: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", len(days)) + struct.pack(">ii", DIMENSION, 3) + b"".join(text(n) + struct.pack(">i", s) for n, s in (("time", 0), ("lat", len(lat)), ("lon", len(lon)))) + struct.pack(">ii", 0, 0) + struct.pack(">ii", VARIABLE, len(variables))
        for (name, own, attributes, size), begin in zip(variables, begins, strict=True):
            out += text(name) + struct.pack(f">i{len(own)}i", len(own), *own) + notes(attributes) + struct.pack(">iiq", 6, min(size, (1 << 31) - 4), begin)
        return out

    at = len(head([0] * len(variables)))
    begins = {"lat": at, "lon": at + 8 * len(lat)}
    first = at + 8 * (len(lat) + len(lon))
    for k, (name, own, _, _) in enumerate(v for v in variables if v[1][0] == 0):
        begins[name] = first + (8 if k else 0) + max(0, k - 1) * slab
    parts = [head([begins[v[0]] for v in variables]), np.array(lat, ">f8").tobytes(), np.array(lon, ">f8").tobytes()]
    for day in sorted(days):
        parts.append(struct.pack(">d", (day - EPOCH).days))
        for name in names:
            values = np.full((len(lat), len(lon)), FILL, ">f8")
            for r in days[day]:
                if r[name] is not None and r[name] == r[name]:
                    values[row[r["lat"]], col[r["lon"]]] = r[name]
            parts.append(values.tobytes())
    return b"".join(parts)


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "isobath-netcdf"

    def schema(self) -> str:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no NetCDF files in {self.options['path']}")
        fields = [v.name for v in Cube(self.options["path"], files[0]).fields]
        return ", ".join(["date date", "lat double", "lon double", *(f"`{n}` double" for n in fields)])

    def reader(self, schema: StructType) -> NetcdfReader:
        return (PushedReader if self.options.get("pushdown") == "true" else NetcdfReader)(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(schema, self.options, overwrite)


def by_date(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows dealt by ranges of dates, so that a date is in one file and a file holds neighbouring dates."""
    return df.repartitionByRange(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "date").sortWithinPartitions("date")


def write_netcdf(df: DataFrame, path: str, *, units: str = "", mode: str = "overwrite", tasks: int | None = None) -> None:
    """``date, lat, lon`` and variables as a folder of NetCDF files."""
    df.sparkSession.dataSource.register(NetcdfSource)
    by_date(df, tasks).write.format(NetcdfSource.name()).option("units", units).mode(mode).save(path)


def read_netcdf(spark: SparkSession, path: str, *, dates: tuple[str, str] | None = None) -> DataFrame:
    """The long table of a file or folder; only records of the dates from the first to the second are read."""
    spark.dataSource.register(NetcdfSource)
    reader = spark.read.format(NetcdfSource.name())
    if dates:
        reader = reader.option("start", dates[0]).option("end", dates[1])
    return reader.load(path)


def read_netcdf_date(spark: SparkSession, path: str, date: str, required: tuple[str, ...] = ()) -> DataFrame:
    """The cells of one date; fails if a required variable or the date isn't there."""
    df = read_netcdf(spark, path, dates=(date, date))
    if lost := [n for n in required if n not in df.columns]:
        raise ValueError(f"no variable {', '.join(lost)} in {path}")
    if df.isEmpty():
        raise ValueError(f"no record of {date} in {path}")
    return df
