import random
import re

import pytest

from isobath.llm import decontaminate as D


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", lower)


def shingles(text, size):
    w = words(text)
    return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(docs, items):
    out = set()
    for item, text in items:
        size = min(5, len(words(text)))
        own = shingles(text, size) if size else set()
        for k, (doc, body) in enumerate(docs):
            n = len(own & shingles(body, size)) if own else 0
            if own and n >= 0.8 * len(own):
                out.add((k, doc, item, n, len(own)))
    return sorted((d, i, n, m) for _, d, i, n, m in out)


def corpus(seed, n_docs=60, n_items=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 20, 37, 64, 65, 150])))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        parts = [word() for _ in range(rng.choice([0, 5, 50, 900, 4000]))]
        for _, text in rng.sample(items, 3):
            own = text.split()
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = "changed"
            if rng.random() < 0.3:
                own = [x.upper() + "!!" for x in own]
            at = rng.randint(0, len(parts))
            parts[at:at] = own
        docs.append((d, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs, items = corpus(seed)
    found = D.find_contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_items=10)
    assert sorted((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in found.collect()) == brute(docs, items)


def test_edges(spark):
    docs = [(1, None, 1), (2, "", 2), (None, "one two three four five six", None), (3, "x " * 30 + "ONE, two; three four five-six", 3), (3, "x " * 30 + "ONE, two; three four five-six", 3)]
    items = [(10, "one two three four five six", "a"), (10, "one two three four five six", "b"), (11, None, "c"), (12, "", "d"), (13, "...", "e"), (None, "two three", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    i = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = sorted(((r["doc_id"] or 0, r["item_id"] or 0) for r in D.find_contained(d, i).collect()))
    assert got == [(0, 0), (0, 10), (0, 10), (3, 0), (3, 0), (3, 10), (3, 10), (3, 10), (3, 10)]
    assert D.find_contained(d.limit(0), i).collect() == []
    assert D.find_contained(d, i.limit(0)).collect() == []


def test_words_never_cross_texts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f g")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "b c d e f")], "item_id long, text string")
    assert D.find_contained(docs, items).collect() == []
