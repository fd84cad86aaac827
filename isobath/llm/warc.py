"""WARC archives: writing segmented records, and reading them back whole.

Reading goes through Spark's text source, so it works wherever Spark can read: gzip, one member a
file or one a record, or plain.  A compressed file is never split, so its lines arrive in order; a
plain one's are shuffled by file and sorted.  ``Content-Length`` cuts lines into records, so a task
holds one record at a time.  Records that
carry segment numbers are grouped by their origin's identifier, ordered by number and joined; the
number of segments and the total length are verified.  At last chunked transfer framing is decoded.

Each record read has ``problem``: null, or why it can't be used (``truncated``, ``segments``,
``length``, ``framing``, ``digest``); no record is dropped.

Writing: one row per record, in files of the text writer whose line separator is the record's end,
so output is committed as any of Spark's.

Defined results: a null payload is empty; equal payloads of ``least`` bytes or more are one
response, the row with the largest id and of those the last, and revisits of it; null ids are
smallest; other columns of the pages aren't written; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm.common import arrow_type, attach, fresh_path

LEAST = 1000
SEGMENT = 16384
CHUNK = 4096
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of chunked framing; None if the framing is broken or incomplete."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        digits = body[at:end].split(b";", 1)[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return None
        size, at = int(digits, 16), end + 2
        if not size:
            break
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2
    while True:  # trailers, up to an empty line
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        if end == at:
            return b"".join(parts)
        at = end + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def segments(fields: list[tuple[str, str]], record_id: str, block: bytes, most: int) -> Iterator[bytes]:
    """One record, or the first and its continuations of at most ``most`` bytes each."""
    if len(block) <= most:
        yield record(fields, block)
        return
    count = -(-len(block) // most)
    for k in range(count):
        part = block[k * most : (k + 1) * most]
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == count - 1 else []
        if k:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{k + 1}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{record_id}>")]
            yield record([*own, ("WARC-Segment-Number", str(k + 1)), *last], part)
        else:
            yield record([*fields, ("WARC-Segment-Number", "1")], part)


def with_revisits(pages: DataFrame, id_col: str, uri: Column, payload: Column, least: int = LEAST) -> DataFrame:
    """``id``, ``row``, ``uri``, ``payload`` and, for a revisit, the response's ``first`` (id, row)."""
    rows = pages.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), uri.cast("string").alias("uri"), F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))
    # what is too short to be revisited is a key of its own
    own = F.when(F.length("payload") >= least, F.sha2("payload", 256)).otherwise(F.concat(F.lit("row "), "row"))
    met = attach(rows.withColumn("same", own), ["same"], ["row"], {"first": (F.max(F.struct("id", "row")), F.max)})
    return met.select("id", "row", "uri", "payload", F.when(F.col("first.row") != F.col("row"), F.col("first")).alias("first"))


def write_archives(pages: DataFrame, path: str, *, id_col: str, uri: Column, payload: Column, least: int = LEAST, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Write a record for each row; record ids are ``urn:record:<id>:<row>``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def name(own: object, row: int) -> str:
            return f"urn:record:{'' if own is None else own}:{row}"

        for batch in batches:
            for i in range(batch.num_rows):
                own, row, uri_, payload_, first = (batch.column(k)[i].as_py() for k in range(5))
                record_id = name(own, row)
                digest = "sha1:" + base64.b32encode(hashlib.sha1(payload_).digest()).decode()
                fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri_ or "urn:none"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", digest)]
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if first:
                    fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{name(first['id'], first['row'])}>")]
                    block = http + b"Content-Length: %d\r\n\r\n" % len(payload_)
                else:
                    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload_, chunk)
                out = list(segments(fields, record_id, block, segment))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = with_revisits(pages, id_col, uri, payload, least).mapInArrow(write, "record binary")
    # the bytes of a binary stay as they are in a string, and in what the text writer writes of it
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "THREE").text(path)


RECORD = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("block", T.BinaryType()), T.StructField("problem", T.StringType())])


class Cutter:
    """Cuts the lines of one file into records."""

    def __init__(self) -> None:
        self.fields: dict[str, str] | None = None
        self.inside = False
        self.parts: list[bytes] = []
        self.missing = 0

    def line(self, line: bytes) -> tuple[dict[str, str], bytes, str | None] | None:
        """Take a line without its line feed; a record, if it ends with this line."""
        if self.inside:
            self.parts.append(line + b"\n" if len(line) < self.missing else line[: self.missing])
            self.missing -= len(self.parts[-1])
            return self.end() if not self.missing else None
        text = line.rstrip(b"\r")
        if self.fields is None:
            if text.startswith(b"WARC/"):
                self.fields = {}
            return None
        if text:
            key, _, value = text.decode("utf-8", "replace").partition(":")
            self.fields[key.strip().lower()] = value.strip()
            return None
        size = self.fields.get("content-length", "")
        self.inside, self.missing = True, int(size) if size.isdigit() else 0
        return self.end() if not self.missing else None

    def end(self) -> tuple[dict[str, str], bytes, str | None] | None:
        """The record so far, at its end or at the file's."""
        if self.fields is None:
            return None
        found = self.fields, b"".join(self.parts), "truncated" if self.missing or not self.inside else None
        self.__init__()
        return found


def row_batch(rows: list[tuple[dict[str, str], bytes, str | None]]) -> pa.RecordBatch:
    bare = lambda x: x.strip("<> ") if x else None
    shape = arrow_type(RECORD)
    return pa.RecordBatch.from_arrays([
        pa.array([bare(f.get("warc-record-id")) for f, _, _ in rows], pa.string()),
        pa.array([f.get("warc-type") for f, _, _ in rows], pa.string()),
        pa.array([list(f.items()) for f, _, _ in rows], shape.field(2).type),
        pa.array([b for _, b, _ in rows], pa.binary()),
        pa.array([p for _, _, p in rows], pa.string()),
    ], schema=shape)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of every ``.gz`` and ``.warc`` file below ``path`` as they are stored, segments apart."""

    def lines(names: str) -> DataFrame:
        text = spark.read.option("lineSep", "\n").option("pathGlobFilter", names).text(path)
        place = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        return text.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), place[0].alias("block"), place[1].alias("at"))

    # Spark splits plain files: their lines are brought together again, in order
    plain = lines("*.warc").repartition("file").sortWithinPartitions("file", "block", "at")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last, rows, size = Cutter(), None, [], 0
        for batch in batches:
            files = batch.column(1).to_numpy()
            changed = set((np.flatnonzero(files[1:] != files[:-1]) + 1).tolist())
            if last is not None and len(files) and files[0] != last:
                changed.add(0)
            for i, line in enumerate(batch.column(0).to_pylist()):
                found = [cutter.end()] if i in changed else []
                found.append(cutter.line(line))
                for x in found:
                    if x:
                        rows.append(x)
                        size += len(x[1])
                if size > 4 << 20:
                    yield row_batch(rows)
                    rows, size = [], 0
            last = files[-1] if len(files) else last
        rows += [x] if (x := cutter.end()) else []
        yield row_batch(rows)

    stored = [lines("*.gz").select("line", "file"), plain.select("line", "file")]
    return stored[0].mapInArrow(cut_up, RECORD).unionByName(stored[1].mapInArrow(cut_up, RECORD))


def joined(parts: list[tuple[int, dict[str, str], bytes, str | None]]) -> tuple[dict[str, str], bytes, str | None]:
    """The record of the segments ``parts``, in order of their numbers."""
    fields, blocks, problem, total, wanted = parts[0][1], [], None, None, 1
    for number, own, block, wrong in parts:
        if blocks and number == wanted - 1 and block == blocks[-1]:
            continue  # a segment that is stored twice
        if number != wanted:
            problem = problem or "segments"
        problem = problem or wrong
        wanted = number + 1
        blocks.append(block)
        total = own.get("warc-segment-total-length") or total
    body = b"".join(blocks)
    if not problem and (total is None or parts[0][1].get("warc-type") == "continuation"):
        problem = "segments"
    if not problem and total != str(len(body)):
        problem = "length"
    return fields, body, problem


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: segments grouped by origin, ordered, joined and verified."""
    number = F.col("fields")["warc-segment-number"].try_cast("int")
    origin = F.coalesce(F.trim(F.translate(F.col("fields")["warc-segment-origin-id"], "<>", "  ")), F.col("record_id"))
    whole = records.where(number.isNull())
    parts = records.where(number.isNotNull()).select(origin.alias("origin"), number.alias("number"), *RECORD.names)
    parts = parts.repartition("origin").sortWithinPartitions("origin", "number")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                own, number_, _, _, fields, block, problem = (batch.column(k)[i].as_py() for k in range(7))
                if held and own != last:
                    yield row_batch([joined(held)])
                    held = []
                last = own
                held.append((number_, dict(fields), block, problem))
        if held:
            yield row_batch([joined(held)])

    return whole.unionByName(parts.mapInArrow(join_up, RECORD))


def http_payload(block: bytes) -> tuple[dict[str, str], bytes | None]:
    """Header fields of an HTTP response, and its payload without transfer framing (None if broken)."""
    head, gap, body = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.decode("utf-8", "replace").partition(":")
        fields[key.strip().lower()] = value.strip()
    if not gap:
        return fields, None
    return fields, dechunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body


PAYLOAD = T.StructType([*RECORD.fields[:3], T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("problem", T.StringType())])


def payloads(records: DataFrame) -> DataFrame:
    """Responses with their decoded payload, its length and hex SHA-1, verified against the header;
    revisits with the length and digest of what they revisit, and no payload."""

    def hexed(digest: str | None) -> str | None:
        label, _, value = (digest or "").partition(":")
        try:
            return base64.b32decode(value).hex() if label.lower() == "sha1" and len(value) == 32 else value.lower() or None
        except ValueError:
            return None

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_type(PAYLOAD)
        for batch in batches:
            out: list[list[object]] = [[], [], [], []]
            for kind, fields, block, problem in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                stated = hexed(dict(fields or ()).get("warc-payload-digest"))
                http, body = http_payload(block)
                if kind == "revisit":
                    size = http.get("content-length", "")
                    row = None, int(size) if size.isdigit() else None, stated, problem
                elif body is None:
                    row = None, None, None, problem or "framing"
                else:
                    digest = hashlib.sha1(body).hexdigest()
                    row = body, len(body), digest, problem or ("digest" if stated not in (None, digest) else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, shape.field(3 + k).type) for k, x in enumerate(out))], schema=shape)

    return records.mapInArrow(decode, PAYLOAD)


def archived(pages: DataFrame, *, id_col: str = "page_id", uri: Column | None = None, payload: Column | None = None) -> DataFrame:
    """Write ``pages`` to fresh archives in the shared folder and read their records back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    write_archives(pages, path, id_col=id_col, uri=F.col("url") if uri is None else uri, payload=F.encode("html", "UTF-8") if payload is None else payload)
    return payloads(reassembled(read_records(spark, path)))
