"""Token counts without token ids, for byte-level BPE tokenizers in a ``tokenizers`` JSON file.

A text's count is the sum over its distinct pre-tokens of frequency times pieces, and special
strings count one each.  The pieces of a pre-token are counted once in the whole corpus:

1. every task counts its pre-tokens, tasks' counts are summed per pre-token, and the library
   encodes each distinct pre-token; the table (pre-token, count, pieces) goes to the shared folder;
2. per-document frequencies meet that table.  The most frequent pre-tokens, at most ``frequent`` of
   them (20 bytes each: a 128-bit hash and the pieces), travel to the documents, where nearly all
   look-ups end; every other (document, pre-token, frequency) is shuffled to the table by
   pre-token and summed per document.  Frequent keys are therefore never shuffled per document.

Defined results: null text is empty and has 0 tokens; special strings in texts are special tokens,
as by the library's default; texts are counted whole, however
long; rows are independent, repeated rows too; an empty table gives no rows; the
output has the id, ``n_bytes`` and ``n_tokens`` and no other input column.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm.common import arrow_type, cut, decoded, slices, text_rows

#: Most pre-tokens that travel to the documents, and most that a task or a worker holds.
FREQUENT = 1 << 19
HELD = 150_000

#: Blocks of Unicode whose letters, digits and spaces every version since 12 has alike; texts with
#: other characters are split by the library itself.
SETTLED = ((0x0, 0x557), (0x900, 0xC50), (0x2000, 0x206F), (0x3040, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The character by which byte-level tokenizers write each byte: itself if it is printable, else one of those from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - set(own)))}


@lru_cache(maxsize=1)
def patterns() -> tuple[re.Pattern[str], re.Pattern[str]]:
    """The byte-level pre-token pattern over settled blocks, and what matches any other character."""
    import regex

    def members(kind: str) -> str:
        points = [c for a, b in SETTLED for c in range(a, b + 1) if regex.match(kind, chr(c))]
        ends = [c for c, after in zip(points, [*points[1:], -1], strict=True) if after != c + 1]
        begins = [c for c, before in zip(points, [-1, *points[:-1]], strict=True) if before != c - 1]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(begins, ends, strict=True))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    other = f"[^{space}{letter}{number}]"
    split = re.compile(f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?{other}+|[{space}]+(?![^{space}])|[{space}]+")
    return split, re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in SETTLED) + "]")


class Splitter:
    """Splits texts into pre-tokens as the tokenizer does."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        own = json.loads(definition)
        pre = own.get("pre_tokenizer") or {}
        if own.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level tokenizers without normalizer and prefix space can be split")
        specials = own.get("added_tokens") or []
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in specials):
            raise ValueError("only added tokens that match as they are can be split off")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = re.compile("|".join(re.escape(x["content"]) for x in sorted(specials, key=lambda x: -len(x["content"])))) if specials else None
        self.split, self.unsettled = patterns()
        tokenize, letters = self.tokenizer.model.tokenize, byte_letters()

        @lru_cache(maxsize=HELD)
        def count(pre_token: str) -> int:
            """Tokens of a pre-token, by the library's model alone; the ``HELD`` last used ones are remembered."""
            return len(tokenize(pre_token.encode().decode("latin-1").translate(letters)))

        self.count = count

    def part(self, text: str) -> list[str]:
        if self.unsettled.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.split.findall(text)

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special tokens between them."""
        if self.special is None or not self.special.search(text):
            return self.part(text), 0
        parts = self.special.split(text)
        return [x for part in parts for x in self.part(part)], len(parts) - 1

    def runs(self, text: str) -> list[tuple[str, bool]]:
        """The text in order as special strings (true) and what lies between them."""
        found, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            found += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*found, (text[at:], False)]

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        self.tokenizer.encode_special_tokens = True
        try:
            return [len(x) for x in self.tokenizer.encode_batch_fast(pre_tokens, add_special_tokens=False)]
        finally:
            self.tokenizer.encode_special_tokens = False


@lru_cache(maxsize=1)
def splitter_of(definition: str) -> Splitter:
    """One splitter per worker."""
    return Splitter(definition)


def distinct_pieces(docs: DataFrame, definition: str, text_col: str = "text", held: int = HELD) -> DataFrame:
    """``pre``, ``n`` (occurrences in all texts) and ``pieces`` of every distinct pre-token."""
    known = docs.sparkSession.sparkContext.broadcast(definition)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, counts = splitter_of(known.value), Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for text in decoded(part.column(0)):
                    counts.update(splitter(text)[0])
                if len(counts) >= held:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["pre", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pre", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        splitter = splitter_of(known.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(splitter.pieces(batch.column(0).to_pylist()), pa.int32())], names=["pre", "n", "pieces"])

    texts = text_rows(docs, text_col, text_col).select("text")
    counted = texts.mapInArrow(count, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(encode, "pre string, n long, pieces int")


class Table:
    """Pieces of the frequent pre-tokens by their 128-bit hash."""

    def __init__(self, packed: list[bytes]) -> None:
        rows = np.frombuffer(b"".join(packed), np.dtype([("high", ">u8"), ("low", ">u8"), ("pieces", "<u4")]))
        high = rows["high"].astype(np.uint64)
        order = np.argsort(high, kind="stable")
        high = high[order]
        twice = np.zeros(len(high) + 1, bool)
        twice[1:-1] = high[1:] == high[:-1]
        single = ~(twice[1:] | twice[:-1])  # hashes that agree in half are looked up in the table itself
        self.high = high[single]
        self.low = rows["low"].astype(np.uint64)[order][single]
        self.pieces = rows["pieces"].astype(np.int64)[order][single]

    def find(self, pre_tokens: list[str]) -> np.ndarray:
        """Pieces of each, -1 if it isn't here."""
        from xxhash import xxh3_128_digest

        asked = np.frombuffer(b"".join([xxh3_128_digest(x.encode()) for x in pre_tokens]), ">u8").astype(np.uint64).reshape(-1, 2)
        if not len(self.high) or not len(asked):
            return np.full(len(asked), -1, np.int64)
        at = np.minimum(np.searchsorted(self.high, asked[:, 0]), len(self.high) - 1)
        return np.where((self.high[at] == asked[:, 0]) & (self.low[at] == asked[:, 1]), self.pieces[at], -1)


def frequent_table(pieces: DataFrame, most: int) -> Table:
    """The most frequent pre-tokens, ``most`` at most: all above a count that so few reach."""
    rank = F.floor(F.log2("n") * 64).alias("rank")
    above, least = 0, None
    for r in sorted(pieces.groupBy(rank).count().collect(), reverse=True):  # at most 64 ranks a bit of the count
        above += r["count"]
        if above > most:
            break
        least = r["rank"]
    if least is None:
        return Table([])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = b"".join([xxh3_128_digest(x.encode()) + n.to_bytes(4, "little") for x, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.binary())], names=["packed"])

    return Table([r["packed"] for r in pieces.where(rank >= least).select("pre", "pieces").mapInArrow(pack, "packed binary").collect()])


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes`` and ``n_tokens``.  ``path``: the tokenizer's JSON, on the driver."""
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    pieces = cut(distinct_pieces(docs, definition, text_col), "pieces")
    context = docs.sparkSession.sparkContext
    known, table = context.broadcast(definition), context.broadcast(frequent_table(pieces, frequent))
    rows = text_rows(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    rest = T.ArrayType(T.StructType([T.StructField("pre", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("here", T.LongType()), T.StructField("rest", rest)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, frequent_ones, shape = splitter_of(known.value), table.value, arrow_type(schema)
        for batch in batches:
            for part in slices(batch, 2):
                texts = decoded(part.column(2))
                size, here, keys, times, ends = [], [], [], [], [0]
                for text in texts:
                    own, special = splitter(text)
                    own = Counter(own)
                    size.append(len(text.encode()))
                    here.append(special)
                    keys += own.keys()
                    times += own.values()
                    ends.append(len(keys))
                found, times = frequent_ones.find(keys), np.array(times, np.int64)
                doc = np.repeat(np.arange(len(texts)), np.diff(ends))
                total = np.array(here, np.int64)
                np.add.at(total, doc, np.where(found >= 0, found * times, 0))
                others: list[list[dict[str, object]]] = [[] for _ in texts]
                for i in np.flatnonzero(found < 0).tolist():
                    others[doc[i]].append({"pre": keys[i], "n": int(times[i])})
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(total), pa.array(others, shape.field(4).type)], schema=shape)

    # a document without such pre-tokens keeps one row, under a key of its own that no pre-token has
    each = rows.mapInArrow(count, schema).select("row", "id", "n_bytes", "here", F.explode_outer("rest").alias("rest"))
    each = each.select("row", "id", "n_bytes", "here", F.coalesce("rest.pre", F.col("row").cast("string")).alias("pre"), F.col("rest").isNotNull().alias("asked"), F.coalesce("rest.n", F.lit(0)).alias("n"))
    met = each.join(pieces.select("pre", F.lit(True).alias("asked"), "pieces"), ["pre", "asked"], "left")
    more = F.when(F.col("asked"), F.coalesce(F.col("n") * F.col("pieces"), F.raise_error(F.lit("a pre-token is missing")).cast("long"))).otherwise(0)
    summed = met.groupBy("row", "id", "n_bytes", "here").agg(F.sum(more).alias("more"))
    return summed.select(F.col("id").alias(id_col), "n_bytes", (F.col("here") + F.col("more")).alias("n_tokens"))
