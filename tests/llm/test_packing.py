import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isobath.llm import packing as P
from isobath.llm.token_counts import Splitter


def check_plan(rows, lengths, capacities):
    """Every unit of every document once, no overlap in a bin, each bin the least that holds it."""
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["piece_start"], r["piece_length"]))
        by_bin.setdefault(r["bin_id"], []).append((r["bin_offset"], r["piece_length"], r["bin_size"]))
    assert set(by_doc) == set(lengths)
    for d, pieces in by_doc.items():
        at = 0
        for _, start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == lengths[d]
    for members in by_bin.values():
        at = 0
        for offset, n, _ in sorted(members):
            assert offset == at
            at += n
        assert {m[2] for m in members} == {min(c for c in capacities if c >= at)}


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_whole_and_tight(spark, seed):
    rng = random.Random(seed)
    lengths = {i: rng.choice([0, 1, 7, rng.randint(0, 40), rng.randint(0, 64), 64, 200]) for i in range(400)}
    docs = spark.createDataFrame([(i, "x" * n) for i, n in lengths.items()], "doc_id long, text string")
    capacities = (16, 32, 64)
    rows = P.pack(docs, F.octet_length("text"), capacities=capacities, quadratic=256.0, overhead=2.0, shard_rows=100).collect()
    check_plan(rows, lengths, capacities)


def test_best_fit_prefers_the_fullest_bin():
    lengths = np.array([60, 50, 9, 4])
    bins, offsets, used = P.best_fit(lengths, (64,), {64: 1.0})
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 50, 60] and used == [64, 59]


def test_joint_plan_is_never_dearer_than_a_single_size():
    rng = np.random.default_rng(1)
    capacities = P.CAPACITIES
    costs = {c: P.cost(c) for c in capacities}
    for _ in range(5):
        lengths = np.sort(rng.lognormal(7.5, 1.0, 500).astype(np.int64).clip(0, capacities[-1]))[::-1]
        bins, _, sizes = P.pack_lengths(lengths, capacities, P.QUADRATIC, P.OVERHEAD)
        _, first = np.unique(bins, return_index=True)
        total = sum(costs[int(sizes[i])] for i in first)
        _, _, used = P.best_fit(lengths, capacities, costs, capacities[-1])
        assert total <= len(used) * costs[capacities[-1]]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "abc", 6)], "doc_id long, text string, piece long")
    rows = P.pack(docs, F.octet_length("text")).collect()
    assert len(rows) == 3 and sum(r["piece_length"] for r in rows) == 3
    assert P.pack(docs.limit(0), F.octet_length("text")).collect() == []


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def tokens(texts):
    library = Tokenizer.from_file(TOKENIZER)
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_the_model_alone_counts_as_the_library():
    splitter = Splitter(open(TOKENIZER, encoding="utf-8").read())
    rng = random.Random(2)
    odd = ["".join(chr(rng.choice((rng.randrange(1, 0x250), rng.randrange(0x20, 0x7F), rng.randrange(0x370, 0xD7A4), rng.randrange(0xE000, 0x110000)))) for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    odd += ["", "a", " ", "  x", "don't  stop\n \n", "x" * 3000, "<|endoftext|>", "a <|endoftext|> b", "\x00\x7f\xad\xa0", *map(chr, range(1, 0x180))]
    assert [sum(n for *_, n in P.cut_text(splitter, x, 1 << 30)) for x in odd] == tokens(odd)


def test_frequent_pre_tokens_are_tokenized_once(monkeypatch):
    """Many rare pre-tokens between two uses of a frequent one don't make it forgotten."""
    monkeypatch.setattr("isobath.llm.token_counts.HELD", 100)
    splitter = Splitter(open(TOKENIZER, encoding="utf-8").read())
    for k in range(300):
        P.cut_text(splitter, f" often rare{k:04d} often", 1 << 30)
    found = splitter.count.cache_info()
    assert found.currsize == 100 and found.hits >= 599 and found.misses <= 701


def test_query_is_whole(spark):
    from isobath.llm.common import table
    from isobath.llm.queries import op7_best_fit

    sf = "/root/testdata/sf0.001"
    rows = table(spark, sf, "documents").collect()
    lengths = dict(zip([r["doc_id"] for r in rows], tokens([r["text"] or "" for r in rows]), strict=True))
    got, by_bin = {}, {}
    for r in op7_best_fit(spark, sf).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["piece_length"]
        by_bin.setdefault((r["bin_id"], r["bin_size"]), []).append((r["bin_offset"], r["piece_length"]))
    assert got == lengths
    for (_, size), members in by_bin.items():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert size == min(c for c in P.CAPACITIES if c >= at)


def test_sequences_hold_the_texts(spark):
    texts = {1: "one two three four five six seven eight nine ten", 2: None, 3: "", 4: "naïve café — " * 30, 5: "x" * 500, 6: "a <|endoftext|> b", 7: "short"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("piece", F.lit(2))
    rows = P.sequences(docs, TOKENIZER, capacities=(8, 16, 32), quadratic=64.0, overhead=1.0).collect()
    found = {}
    for r in rows:
        assert r["n_tokens"] == sum(r["lengths"]) <= r["bin_size"]
        for d, k, start, n, t in zip(r["doc_ids"], r["pieces"], r["starts"], r["lengths"], r["texts"], strict=True):
            found.setdefault(d, []).append((k, start, t))
            assert n <= 32
    assert {d: "".join(t for *_, t in sorted(x)) for d, x in found.items()} == {d: t or "" for d, t in texts.items()}
    for pieces in found.values():
        at = 0
        for _, start, t in sorted(pieces):
            assert start == at
            at += len(t)


@pytest.mark.parametrize("parts", (1, 3, 16))
def test_plan_does_not_hang_on_the_layout(spark, parts):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "word " * rng.randint(0, 90)) for i in range(300)], "doc_id long, text string")
    plan = lambda d: sorted(P.pack_texts(d, TOKENIZER, capacities=(32, 64), shard_rows=50).collect())
    assert plan(docs.repartition(parts)) == plan(docs.coalesce(1))


def test_repeated_rows_are_dealt(spark):
    docs = spark.createDataFrame([(None, "same text")] * 400, "doc_id long, text string")
    rows = P.pack_texts(docs, TOKENIZER, capacities=(8,), shard_rows=50).collect()
    assert len(rows) == 400 and len({r["bin_id"] >> 32 for r in rows}) > 4


def cheapest(lengths, costs):
    """The least cost of any packing, by trying every partition."""
    if not lengths:
        return 0
    head, *rest = lengths
    found = float("inf")
    for mask in range(1 << len(rest)):
        own = head + sum(n for i, n in enumerate(rest) if mask >> i & 1)
        fits = [c for c in costs if c >= own]
        if fits:
            found = min(found, costs[min(fits)] + cheapest([n for i, n in enumerate(rest) if not mask >> i & 1], costs))
    return found


def test_cost_against_the_optimum_of_small_inputs():
    rng, optimal = random.Random(11), 0
    capacities = (8, 16, 32)
    costs = {c: P.cost(c, 64.0, 2.0) for c in capacities}
    for _ in range(60):
        lengths = sorted((rng.randint(1, 32) for _ in range(rng.randint(1, 7))), reverse=True)
        bins, _, sizes = P.pack_lengths(np.array(lengths), capacities, 64.0, 2.0)
        got = sum(costs[int(sizes[np.flatnonzero(bins == b)[0]])] for b in set(bins.tolist()))
        best = cheapest(lengths, costs)
        assert best - 1e-9 <= got <= 1.35 * best
        optimal += got <= best + 1e-9
    assert optimal >= 40


def test_each_piece_goes_where_it_fits_best():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 65, 300))[::-1]
    bins, offsets, _ = P.best_fit(lengths, (64,), {64: 1.0})
    used = {}
    for n, b, at in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        open_ones = [u for u in used.values() if u + n <= 64]
        assert used.get(b, 0) == at == (max(open_ones) if open_ones else 0)
        used[b] = at + n
