import hashlib
import random

import numpy as np
import pytest

from isobath.llm import anchors as A
from isobath.llm import repeats as R
from isobath.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(rows, depth=50):
    key = lambda i: R.LAST if i is None else i
    first = {}
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for i, b in bodies:
        for p in range(len(b) - depth + 1):
            s = b[p : p + depth]
            first[s] = min(first.get(s, R.LAST), key(i))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if first[b[p : p + depth]] < key(i):
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in R.remove_repeats(df, **kw).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    passages = ["".join(word() for _ in range(rng.randint(4, 40))) for _ in range(6)] + ["z" * 120, "xy" * 60]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                a = rng.randint(0, len(p) // 2)
                p = p[a : a + rng.randint(20, 90)]
            parts.append(p)
            if rng.random() < 0.6:
                parts.append(word())
        rows.append((i * 3 % 80, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,shard_bytes", [(0, 1 << 20), (1, 4000), (2, 900), (3, 300)])
def test_against_brute_force(spark, seed, shard_bytes):
    rows = corpus(seed)
    assert run(spark, rows, shard_bytes=shard_bytes) == brute(rows)


def test_query_against_brute_force(spark):
    from isobath.llm.queries import op2_repeats

    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert sorted((tuple(r) for r in op2_repeats(spark, SF).collect()), key=repr) == brute(rows)


def test_edges(spark):
    long = "abcdefghij" * 6
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, long), (None, long), (5, long), (5, long + "!"), (4, "x" + long), (6, long[:49]), (7, long[:50])]
    for size in (1 << 20, 60):
        assert run(spark, rows, shard_bytes=size) == brute(rows)
    df = spark.createDataFrame([(1, "a", 2, "b")], "doc_id long, text string, shard long, keys string")
    assert R.remove_repeats(df).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert R.remove_repeats(df.limit(0)).collect() == []


def test_kept_texts_and_hot_passage(spark):
    passage = "A passage that every single document of this table has in common. "
    rows = [(i, f"{i} own words {passage}and {i * 7919} more") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in R.remove_repeats(df, shard_bytes=2000, texts=True).collect()}
    assert kept[0] == rows[0][1].encode() and all(b"single document" not in kept[i] for i in range(1, 300))
    assert run(spark, rows, shard_bytes=2000) == brute(rows)


@pytest.mark.parametrize("most", [64, 1000, 1 << 20])
def test_every_window_has_one_anchor_whatever_the_blocks(most):
    rng = np.random.default_rng(0)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 10, 49, 50, 51, 0, 300, 5, 2000, 50)] + [np.full(400, 97, np.uint8)]
    data, offsets = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seen = {}
    for a in A.text_anchors(data, offsets, 50, 16, most):
        for h, first, count, place in zip(*(x.tolist() for x in a), strict=True):
            for p in range(first, first + count):
                assert p not in seen and p <= place <= p + 34
                seen[p] = (h, place - p)
    wanted = {p for a, b in zip(offsets[:-1], offsets[1:], strict=True) for p in range(a, b - 49)}
    assert set(seen) == wanted
    by_content = {}
    for p, anchor in seen.items():
        assert by_content.setdefault(data[p : p + 50].tobytes(), anchor) == anchor


def test_refinement_orders_like_sorting():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1200] = data[100:300]
    windows = np.arange(0, 2900)
    group = np.zeros(len(windows), np.int64)
    bucket = R.refined(data, windows, group, 50)
    content = [data[p : p + 50].tobytes() for p in windows]
    for i, b in enumerate(bucket):
        assert (b >= 0) == (content.count(content[i]) > 1)
    met = [(b, c) for b, c in zip(bucket, content, strict=True) if b >= 0]
    assert len({b for b, _ in met}) == len({c for _, c in met}) == len(set(met))


def test_rows_that_repeat_an_id_lose_the_same_bytes_in_any_shard(spark):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh") for _ in range(70))
    rows = [(1, "first " + shared[:55])] + [(2, f"{shared} and {k} other words") for k in range(12)] + [(None, f"{shared} and {k}") for k in range(6)]
    for size in (1 << 20, 300, 60):
        assert run(spark, rows, shard_bytes=size) == brute(rows)


def test_contexts_are_told_apart_by_their_bytes(monkeypatch):
    """Equal hashes alone make no copies."""
    monkeypatch.setattr(R, "range_sums", lambda data, first, end, base: np.zeros(len(first), np.uint64))
    texts = [b"a" * 49 + b"b", b"a" * 49 + b"c", b"a" * 49 + b"b"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    shard = R.Shard(np.array([1, 2, 3]), np.arange(3), data, np.array([0, 50, 100, 150]))
    one = np.ones(3, np.int64)
    w = R.Windows(np.zeros(3, np.uint64), np.array([0, 50, 100]), one, one, np.arange(3))
    chosen, number = R.distinct_contexts(shard, w, 50)
    assert number[0] != number[1] != number[2] and set(chosen) <= {0, 1, 2}
    contexts = np.zeros(3, R.CONTEXT)
    contexts["document"], contexts["windows"] = [1, 2, 3], 1
    assert R.earlier(contexts, data, 50).tolist() == [0, 0, 1]
