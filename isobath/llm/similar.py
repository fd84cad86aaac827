"""Near copies by SimHash: ball hashing proposes pairs, exact shingle sets decide.

Two texts are near copies if the sets of their ``shingle``-word shingles have a Jaccard similarity
of ``LEAST`` or more; a component is what such pairs connect.  A node is a distinct set, named by a
64-bit hash of it, so copies count once.  Words are those of ``simhash``; a set holds 64-bit hashes.

Fingerprints.  At a similarity of 0.8 a fingerprint differs in about 0.15 of its bits, too many for
any ball.  So each text has ``BLOCKS`` independent fingerprints of ``BITS`` bits, of its distinct
pairs of neighbouring words.  Bits alone would meet by chance in numbers that grow with the square of the input; so a
block's bits stand below a number of ``64 - BITS`` bits, its bucket, drawn by the least of the block's own hashes of the shingles: texts share it with
a probability that is their similarity, unrelated ones hardly ever.  Values of shared buckets are hashed by
their balls (every variant of the bits within one, shuffled and met, see ``simhash.meeting``); those of a bucket alone meet nothing.
By the binomial law 0.95 of the pairs at a similarity of 0.8 share a bucket and are within two
bits in some block, whatever the edit (words appended or cut off; words replaced change fewer pairs), and 0.98 at 5/6.  Pairs that
differ in more than ``FAR`` bits of all blocks are not similar, but for one in 10^5.

Pairs.  What balls connect within a block is a group; a node is in one group of a block at most, so its rows are ``BLOCKS`` at
most, however large its groups are.  Comparing all of a group would grow with the square of its size.  First each node
is compared with the leads of its groups: the nodes that come first in the block's random order.  What the similar ones among
these pairs connect has one label.  Then, in every group whose nodes have several labels, all pairs of
different labels are compared, in tiles of about ``TILE`` by ``TILE`` nodes, ``STRIP`` rows of them at once, by their bits, their marks and
then their sets, each pair in the first block whose group both are in.  A node's marks are ``MARKS`` bits, those on which its shingles fall: a mark that only one of two nodes has is a
shingle that the other lacks, so marks bound the similarity from above, and no similar pair is lost by them.  So every pair that meets is compared or in one component already; none is left out
for the size of its group.

Null text is empty; texts without a word are one node; ids are told apart as in ``simhash``: rows
are independent, null ids are smallest and never name a component unless all its ids are null; an
empty table gives no rows; no other column is returned or looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm.common import attach, cut, decoded_sets, release, salt_of, slices, text_bytes, text_rows
from isobath.llm.components import components
from isobath.llm.shingles import mix, shingle_hashes
from isobath.llm.simhash import labelled, meeting, stars, text_hashes

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BLOCKS, BITS = 16, 26
#: Words of a fingerprint's features, and variants that are on disk at a time: as many blocks, one at least.
FEATURE, AT_ONCE = 2, 1 << 25
#: Bits of all blocks in which similar texts differ at most: 0.15 of them, and five standard deviations more.
FAR = int(0.15 * BLOCKS * BITS + 5 * (0.15 * 0.85 * BLOCKS * BITS) ** 0.5)
#: Whole words of 64 bits.
MARKS = 1024
TILE, STRIP = 2048, 64
#: Links that one task labels (16 bytes each), and nodes that are broadcast (8 bytes); more are dealt to all.
LINKS = 1 << 20
SEEDS = np.random.default_rng(20240301).integers(0, 2**64, BLOCKS // 2, dtype=np.uint64)
#: Odd factors that give each block an order of its own of mixed numbers.
FACTORS = np.random.default_rng(20240302).integers(0, 2**63, BLOCKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The blocks' buckets of one set: numbers of ``64 - BITS`` bits in place, the block taking part."""
    if not len(hashes):
        return np.zeros(BLOCKS, np.int64)
    mixed = mix(hashes)
    least = np.array([(mixed * factor).min() for factor in FACTORS], np.uint64)
    return (mix(least ^ FACTORS) >> np.uint64(BITS) << np.uint64(BITS)).view(np.int64)


def word_prints(words: np.ndarray) -> np.ndarray:
    """The blocks' bits of one text's word hashes."""
    features = shingle_set(words, FEATURE)
    ones = np.zeros(BLOCKS * 32, np.int64)
    for begin in range(0, len(features), 1 << 12):  # a mixed number of 64 bits serves two blocks
        mixed = mix(features[begin : begin + (1 << 12), None] ^ SEEDS)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(features)).view(np.uint32).astype(np.int64)
    return packed >> (32 - BITS)


def shingle_set(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, in order; fewer words than a shingle are one of all of them."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(words, np.array([0, len(words)], np.int64), min(shingle, len(words)))[0])


def marks_of(hashes: np.ndarray) -> np.ndarray:
    """The bits on which the hashes fall."""
    marks = np.zeros(MARKS, np.uint8)
    marks[(mix(hashes) % np.uint64(MARKS)).astype(np.int64)] = 1
    return np.packbits(marks).view(np.int64)


def may_be_similar(n: np.ndarray, m: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles with these marks, a row each, can be similar."""
    own, other = own.view(np.uint64), other.view(np.uint64)  # of signed numbers the bits of the absolute value would count
    both = np.minimum(n - np.bitwise_count(own & ~other).sum(axis=1, dtype=np.int64), m - np.bitwise_count(other & ~own).sum(axis=1, dtype=np.int64))
    return LEAST[1] * both >= LEAST[0] * (n + m - both)


def set_name(hashes: np.ndarray) -> int:
    return int(mix(np.array([mix(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if LEAST[1] * min(len(a), len(b)) < LEAST[0] * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def texts_of(part: pa.RecordBatch, column: int) -> tuple[pa.Array, list[np.ndarray]]:
    """The texts in lower case, and each one's word hashes."""
    text = pc.ascii_lower(part.column(column).fill_null(""))
    data, ends = text_bytes(text)
    return text, [text_hashes(data[a:b], 1) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``print`` (the node), its size ``n``, the ``balls`` of its blocks (bits below buckets), its ``marks`` and ``text``, in lower case, of every row."""
    rows = text_rows(docs, id_col, text_col)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("print", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("balls", T.ArrayType(T.LongType())), T.StructField("marks", T.ArrayType(T.LongType())), T.StructField("text", T.StringType())])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                text, words = texts_of(part, 1)
                sets = [shingle_set(x, shingle) for x in words]
                prints = np.array([set_name(x) for x in sets], np.uint64).view(np.int64)
                balls = pa.array([word_prints(x) | buckets(y) for x, y in zip(words, sets, strict=True)], pa.list_(pa.int64()))
                marks = pa.array([marks_of(x) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints), pa.array([len(x) for x in sets], pa.int32()), balls, marks, text], names=["id", "print", "n", "balls", "marks", "text"])

    return rows.mapInArrow(every, schema)


def sets_of(rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``print`` and ``hashes``, the set as packed numbers in order, of the nodes."""
    nodes = cut(nodes, "wanted")
    # up to LINKS numbers travel to the texts; beyond, texts and numbers meet by shuffle
    few = F.broadcast(nodes) if nodes.count() <= LINKS else nodes
    texts = rows.select("print", "text").join(few, "print", "left_semi").groupBy("print").agg(F.first("text").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                packed = [shingle_set(x, shingle).tobytes() for x in texts_of(part, 1)[1]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["print", "hashes"])

    return texts.mapInArrow(pack, "print long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar.  Pairs of one ``a`` are dealt over salts."""
    salted = pairs.select("a", "b", salt_of("b").alias("salt"))
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("print").alias("a"), F.col("hashes").alias("left")), "a")
    right = salted.join(sets.select(F.col("print").alias("b"), F.col("hashes").alias("right")), "b")
    met = right.join(left, ["a", "salt"]).select("a", "b", "left", "right")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(a, b) for a, b in zip(decoded_sets(batch.column(2)), decoded_sets(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return met.mapInArrow(check, "a long, b long")


def fits(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar."""
    return LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b)


def shared(nodes: DataFrame) -> DataFrame:
    """``block, print, n, ball`` of every node whose bucket others have too."""
    balls = nodes.select("print", "n", F.posexplode("balls").alias("block", "ball")).withColumn("bucket", F.shiftright("ball", BITS))
    # a bucket may be that of a third of all nodes
    return attach(balls, ["block", "bucket"], ["print"], {"inside": (F.count(F.lit(1)), F.sum)}).where("inside > 1").select("block", "print", "n", "ball")


def gathered(balls: DataFrame) -> DataFrame:
    """``block, group, print, n, lead, size``: the nodes of every group of several, of the values of some blocks.

    ``lead`` is the group's first node in the block's random order.  Of a group of two, only the other one has
    a row, and none if their sizes rule a similarity out.
    """
    values = cut(balls.select("block", "ball").distinct(), "values")
    links = cut(stars(meeting(values.select(F.col("ball").alias("print")).distinct(), BITS)), "balls")
    groups = cut(labels_of(links), "groups")
    # a value may be that of a third of all nodes: nodes and groups of a value meet over salts
    rows = balls.withColumn("own", F.lit(None).cast("long")).unionByName(values.join(groups.withColumnRenamed("node", "ball"), "ball").select("block", F.lit(None).cast("long").alias("print"), F.lit(None).cast("int").alias("n"), "ball", F.col("label").alias("own")))
    placed = attach(rows, ["block", "ball"], ["print"], {"met": (F.max("own"), F.max)})
    members = placed.where("print IS NOT NULL").select("block", F.coalesce("met", "ball").alias("group"), "print", "n")
    first = F.struct(F.xxhash64("block", "print").alias("order"), "print", "n")
    found = attach(members, ["block", "group"], ["print"], {"lead": (F.min(first), F.min), "size": (F.count(F.lit(1)), F.sum)})
    return found.where((F.col("size") > 2) | (F.col("print") != F.col("lead.print")) & fits("n", "lead.n"))


def led(members: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of each node with the leads of its groups."""
    pairs = members.where((F.col("print") != F.col("lead.print")) & fits("n", "lead.n"))
    return pairs.select(F.least("print", "lead.print").alias("a"), F.greatest("print", "lead.print").alias("b")).distinct()


def close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that differ in ``FAR`` bits at most and whose sets' sizes and marks allow a similarity."""
    side = lambda c: nodes.select(F.col("print").alias(c), F.struct("n", "balls", "marks").alias(f"{c}s"))
    total = lambda a, b, count: F.aggregate(F.zip_with(a, b, count), F.lit(0), lambda x, y: x + y)
    bits = total("as.balls", "bs.balls", lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit((1 << BITS) - 1))))
    left = lambda a, b: F.col(f"{a}.n") - total(f"{a}.marks", f"{b}.marks", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    both = F.least(left("as", "bs"), left("bs", "as"))
    allowed = LEAST[1] * both >= LEAST[0] * (F.col("as.n") + F.col("bs.n") - both)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits("as.n", "bs.n") & (bits <= FAR) & allowed).select("a", "b")


def across(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Close pairs ``a`` < ``b`` of one group whose labels differ, all of them, once; groups of two were compared before."""
    group = F.struct("block", "group").alias("group")
    known = members.where("size > 2").select(group, "print").join(labels.withColumnRenamed("node", "print"), "print", "left").select("group", "print", F.coalesce("label", "print").alias("label"))
    # a group may be that of a third of all nodes
    several = attach(known, ["group"], ["print"], {"low": (F.min("label"), F.min), "high": (F.max("label"), F.max)}).where("low <> high")
    rows = cut(several.select("group", "print", "label"), "mixed")
    # a node's groups by block; where it has none stands itself, whom no other has
    places = rows.groupBy("print").agg(F.array(*[F.coalesce(F.max(F.when(F.col("group.block") == k, F.col("group.group"))), F.col("print")) for k in range(BLOCKS)]).alias("places"))
    known = nodes.select("print", "n", "balls", "marks").join(places, "print")
    # the label with most nodes of a group is one side only; the others are both
    sizes = rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("group").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"))
    sized = attach(rows.select("group", "print", "label", F.lit(None).cast("struct<n: long, label: long>").alias("m"), F.lit(None).cast("long").alias("s")).unionByName(sizes.select("group", F.lit(None).cast("long").alias("print"), F.lit(None).cast("long").alias("label"), F.col("main").alias("m"), F.col("all").alias("s"))), ["group"], ["print"], {"main": (F.max("m"), F.max), "every": (F.max("s"), F.max)})
    sized = sized.where("print IS NOT NULL").select("group", "print", "label", (F.col("label") == F.col("main.label")).alias("main"), F.ceil(F.col("every") / TILE).cast("int").alias("columns"), F.greatest(F.ceil((F.col("every") - F.col("main.n")) / TILE), F.lit(1)).cast("int").alias("rows"))
    spread = lambda n: F.pmod(F.xxhash64("print"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sized.where("NOT main").select("group", spread("rows").alias("r"), every("columns").alias("c"), "print", "label", "main", F.lit(True).alias("left"))
    right = sized.select("group", spread("columns").alias("c"), "print", "label", "main", "rows", F.lit(False).alias("left")).select("group", every("rows").alias("r"), "c", "print", "label", "main", "left")
    filled = left.unionByName(right).join(known, "print")
    node = F.struct("print", "label", "n", F.col("main").cast("int").alias("main"), "balls", "marks", "places")
    tiles = filled.groupBy("group", "r", "c").agg(F.collect_list(F.when(F.col("left"), node)).alias("x"), F.collect_list(F.when(~F.col("left"), node)).alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in enumerate(batch.column(2).to_pylist()):
                left, y = (_columns(batch.column(c)[row].values) for c in (0, 1))
                for begin in range(0, len(left[0]), STRIP):
                    x = [c[begin : begin + STRIP] for c in left]
                    met = (x[1][:, None] != y[1]) & ((y[3] == 1) | (x[0][:, None] < y[0]))  # two of the others are on both sides
                    met &= LEAST[1] * np.minimum(x[2][:, None], y[2]) >= LEAST[0] * np.maximum(x[2][:, None], y[2])
                    for k in range(block):
                        met &= x[6][:, k, None] != y[6][:, k]
                    i, j = np.nonzero(met)
                    near = np.bitwise_count((x[4][i] ^ y[4][j]) & ((1 << BITS) - 1)).sum(axis=1) <= FAR
                    i, j = i[near], j[near]
                    allowed = may_be_similar(x[2][i], y[2][j], x[5][i], y[5][j])
                    a, b = x[0][i[allowed]], y[0][j[allowed]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return tiles.select("x", "y", "group.block").mapInArrow(compare, "a long, b long").distinct()


def _columns(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
    single = [rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("print", "label", "n", "main")]
    return (*single, *(rows.field(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), width) for c, width in (("balls", BLOCKS), ("marks", MARKS // 64), ("places", BLOCKS))))


def labels_of(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node that ``links`` reach, of the nodes in them: by one task while they are ``LINKS`` at most."""
    if links.count() > LINKS:
        return components(links)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array([find(x) for x in top], pa.int64())], names=["node", "label"])

    return links.select("a", "b").coalesce(1).mapInArrow(join, "node long, label long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: id, ``print`` and ``component_id``, the least id that similar pairs reach."""
    rows = cut(sketches(docs, id_col, text_col, shingle), "sketches")
    distinct = cut(rows.groupBy("print").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("balls").alias("balls"), F.first("marks").alias("marks")), "distinct")
    nodes = distinct.select("print", "n", "balls", "marks")
    balls = cut(shared(nodes), "shared")
    parts, step = [], max(1, min(BLOCKS, BLOCKS * AT_ONCE // ((BITS + 1) * max(1, balls.count()))))
    for k in range(0, BLOCKS, step):
        parts.append(cut(gathered(balls.where(F.col("block").between(k, min(k + step, BLOCKS) - 1))), "members"))
        release(docs.sparkSession)  # the blocks' variants are on disk no longer than needed
    members = reduce(DataFrame.union, parts)

    def similar_of(pairs: DataFrame) -> DataFrame:
        sets = sets_of(rows, pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct(), shingle)
        return cut(verified(pairs, cut(sets, "sets")), "links")

    links = similar_of(cut(close(led(members), nodes), "pairs"))
    labels = cut(labels_of(links), "labels")
    release(docs.sparkSession)
    more = cut(across(members, labels, nodes), "pairs")
    if not more.isEmpty() and not (found := similar_of(more)).isEmpty():
        labels = cut(labels_of(links.union(found)), "labels")
    return labelled(rows.select("id", "print"), distinct.select("print", "least"), labels, id_col)
