import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from isobath.llm import similar as S
from isobath.llm.common import table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(docs):
    """docs: (id, text); the least id that pairs of similarity 0.8 connect, of every id."""
    sets = {i: brute_set(t) for i, t in docs}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(table(spark, "/root/testdata/sf0.01", "documents")).collect()}
    assert got == brute_components(docs)


def test_large_and_small_groups_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(900, None), (901, " \n"), (None, "of no id"), (902, "too few words"), (903, "Too FEW  words")]
    for group, size in enumerate((2, 5, 9, 60)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(size):
            own = list(words)
            own[rng.randrange(120)] = f"x{group}-{k}"
            docs.append((group * 100 + k, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {None: None, **brute_components([d for d in docs if d[0] is not None])}


def test_stage_takes_what_is_similar_and_nothing_else(spark):
    words = [f"word{i}" for i in range(104)]
    near, far = list(words), list(words)
    near[30] = near[70] = "other"  # 10 of 100 shingles differ: 90 / 110 = 0.82
    far[20] = far[50] = far[80] = "other"  # 85 / 115 = 0.74 to the first
    rows = [(5, " ".join(words), "en", "a", 1), (3, " ".join(near), "en", "a", 1), (9, " ".join(far), "en", "b", 1)]
    left = P.simhash_dedup(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 9]


def test_tiles_compare_all_that_meet(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 3)
    monkeypatch.setattr(S, "LINKS", 0)
    monkeypatch.setattr(S, "AT_ONCE", 1 << 15)
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(docs).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_marks_lose_no_similar_pair_and_rule_out_most_others(spark):
    rng = np.random.default_rng(7)
    sets, kept = {}, []
    for k in range(600):
        base = rng.integers(0, 2**64, int(rng.integers(1, 400)), dtype=np.uint64)
        other = np.concatenate([base[: int(len(base) * rng.uniform(0.4, 1)) + 1], rng.integers(0, 2**64, int(rng.integers(0, 12)), dtype=np.uint64)])
        sets[2 * k], sets[2 * k + 1] = np.unique(base), np.unique(other)
    marks = np.stack([S.marks_of(x) for x in sets.values()])
    n = np.array([len(x) for x in sets.values()])
    kept = S.may_be_similar(n[::2], n[1::2], marks[::2], marks[1::2])
    alike = np.array([S.similar(sets[k], sets[k + 1]) for k in range(0, 1200, 2)])
    assert kept[alike].all() and alike.sum() > 100
    assert kept[~alike].sum() < 0.3 * (~alike).sum()
    # the same bound in SQL
    nodes = spark.createDataFrame([(k, int(n[k]), [0] * S.BLOCKS, marks[k].tolist()) for k in sets], "print long, n int, balls array<long>, marks array<long>")
    pairs = spark.createDataFrame([(k, k + 1) for k in range(0, 1200, 2)], "a long, b long")
    fits = 5 * np.minimum(n[::2], n[1::2]) >= 4 * np.maximum(n[::2], n[1::2])
    assert {r["a"] for r in S.close(pairs, nodes).collect()} == set((2 * np.flatnonzero(kept & fits)).tolist())


KINDS = ("appended", "prepended", "cut", "inserted", "replaced")


def edited(rng, words, kind, share):
    """A copy whose five-word shingles have about the similarity ``share``; all words are new ones."""
    n = len(words)
    new = lambda k: [f"n{rng.randrange(10**9)}" for _ in range(k)]
    many = round((n - 4) * (1 / share - 1))
    if kind == "appended":
        return words + new(many)
    if kind == "prepended":
        return new(many) + words
    if kind == "cut":
        return words[: n - round((n - 4) * (1 - share))]
    if kind == "inserted":
        at = rng.randrange(5, n - 5)
        # shingles over the place are lost too
        return words[:at] + new(max(1, many - 8)) + words[at:]
    own = list(words)
    for at in rng.sample(range(n), max(1, round(n * (1 - share) / (1 + share) / 5))):
        own[at] = new(1)[0]
    return own


def test_recall_of_every_kind_of_edit(spark):
    """Pairs at similarities from 0.8 to 0.95, texts of 30 to 1,000 words; each pair of vocabulary of its own kind."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(400)]
    docs, pairs = [], []
    for kind in KINDS:
        for length in (30, 60, 120, 300, 1000):
            for share in (0.8, 0.82, 0.84, 0.87, 0.9, 0.95):
                for _ in range(8):
                    words = [rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(10**7)}" for _ in range(length)]
                    a, b = " ".join(words), " ".join(edited(rng, words, kind, share))
                    x, y = brute_set(a), brute_set(b)
                    docs += [(len(docs), a), (len(docs) + 1, b)]
                    pairs.append((kind, docs[-2][0], len(x & y) / len(x | y)))
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for kind in KINDS:
        wanted = [i for k, i, s in pairs if k == kind and s >= 0.8]
        assert len(wanted) > 100
        assert sum(got[i + 1] == i for i in wanted) >= 0.93 * len(wanted), kind
    assert all(got[i + 1] == i + 1 for _, i, s in pairs if s < 0.8)


def test_rows_grow_with_the_nodes_not_with_their_groups(spark, monkeypatch):
    """A family of near copies, no two of which are alike, and texts that share no shingle."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = [(k, " ".join(f"u{rng.randrange(10**9)}" for _ in range(60))) for k in range(200)]
    for k in range(120):
        own = list(words)
        for at in rng.sample(range(150), rng.randrange(1, 12)):
            own[at] = f"x{rng.randrange(10**9)}"
        docs.append((1000 + k, " ".join(own)))
    counts, write = {}, S.cut

    def counted(df, name):
        table = write(df, name)
        counts[name] = counts.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(S, "cut", counted)
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)
    assert counts["members"] <= S.BLOCKS * 120 and counts["values"] <= S.BLOCKS * 120
    assert counts["pairs"] <= 120 * 119 // 2 + S.BLOCKS * 120


def test_texts_meet_only_where_they_share_a_shingle(spark):
    """Chance would let equal bits meet, in numbers that grow with the square of the texts."""
    texts = [(k, " ".join(f"u{k}-{i}" for i in range(40))) for k in range(300)] + [(k, " ".join(f"s{i}" for i in range(20, 40 + k % 2))) for k in (300, 301)]
    nodes = S.sketches(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("balls", F.transform("balls", lambda x: F.shiftleft(F.shiftright(x, S.BITS), S.BITS)))
    met = S.shared(nodes).select("print").distinct()
    assert sorted(r["id"] for r in nodes.join(met, "print").collect()) == [300, 301]
