import hashlib
import random

from isobath.llm import exact_dedup as E


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(lower(text), []).append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, keep[lower(t)], len(groups[lower(t)]), i == keep[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in E.equal_texts(df, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_shared_prefixes_of_every_length(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abÄ é\n") for _ in range(400))
    rows = []
    for i in range(250):
        n = rng.choice([0, 1, 2, 3, 4, 5, 8, 31, 32, 33, 64, 399, 400])
        text = base[:n] + rng.choice(["", "", "x", "X", "É", "é"])
        rows.append((i, text if text or rng.random() < 0.5 else None))
    rng.shuffle(rows)
    assert run(spark, rows, widths=(1, 2, 8, 32)) == brute(rows)


def test_hot_group_nulls_and_repeats(spark):
    rows = [(i, "Copy of a Text" * 50) for i in range(300)] + [(7, "copy of a text" * 50), (7, "other"), (7, "other"), (None, "other"), (None, "alone"), (9, "KK"), (10, "Kk")]
    assert run(spark, rows) == brute(rows)


def test_same_id_with_different_texts_stays_apart(spark):
    rows = [(1, "aaaa" + c) for c in "bcbc"] + [(1, "aaaabb"), (2, "aaaabb")]
    assert run(spark, rows, widths=(1,)) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert E.equal_texts(df).collect() == []
    df = spark.createDataFrame([(1, "a", 2, "x")], "doc_id long, text string, n long, sha string")
    assert E.equal_texts(df).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    long = "z" * 700_000
    assert run(spark, [(1, long), (2, long + "y"), (3, long)]) == brute([(1, long), (2, long + "y"), (3, long)])
