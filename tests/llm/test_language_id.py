import zlib

import numpy as np

from isobath.llm import language_id as L
from isobath.llm.common import table

D = 64


def brute_bundle(text):
    symbols = []
    for c in " " + text.lower() + " ":
        s = ord(c) if c.isalpha() else 0
        if s or not symbols or symbols[-1]:
            symbols.append(s)
    total, n = np.zeros(D), 0
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        total += np.roll(L.letter_vector(a, D), 2) * np.roll(L.letter_vector(b, D), 1) * L.letter_vector(c, D)
        n += 1
    return total, n


TEXTS = ["", "a", "Hello, world!", "...", "été naïve 12 x", "a b", "漢字 かな", "\U0001f600", "x1y2z", "İstanbul ΣΑΣ", " lead", "trail "]


def test_bundles_against_brute_force():
    vectors, n = L.bundled(TEXTS, D)
    for text, v, m in zip(TEXTS, vectors, n, strict=True):
        expected, count = brute_bundle(text)
        assert m == count and np.array_equal(v, expected), text


def test_many_grams_and_docs_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["".join(chr(c) for c in rng.integers(0x4E00, 0x4E00 + 300, 40)) for _ in range(40)]
    whole, n = L.bundled(texts, D)
    monkeypatch.setattr(L, "GRAMS", 100)
    monkeypatch.setattr(L, "DOCS", 7)
    parts, m = L.bundled(texts, D)
    assert np.array_equal(whole, parts) and np.array_equal(n, m)
    labels = np.arange(40) % 3
    sums = L.weighted(texts, labels, 3, D)
    expected = np.array([(whole / n[:, None])[labels == k].sum(axis=0) for k in range(3)])
    assert np.allclose(sums, expected)


def test_model_is_the_bundle_of_the_labelled_rows(spark):
    rows = [(1, "alpha beta", "x"), (2, "gamma", "y"), (3, None, "x"), (4, "nobody's", None), (5, "...", "z"), (6, "alpha", "x")]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), dimensions=D)
    assert model.languages == ["x", "y", "z"]
    x = sum(v / n for v, n in map(brute_bundle, ("alpha beta", "alpha")))
    assert np.allclose(model.prototypes[0], x / np.linalg.norm(x), atol=1e-5) and not model.prototypes[2].any()


def test_held_out_accuracy(spark):
    from isobath.llm.queries import op3_language_id

    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    got = op3_language_id(spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    out = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and lang[r["doc_id"]] is not None]
    assert len(out) > 100 and sum(out) / len(out) >= 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 3), (2, "123 !", "en", 3), (None, "word", "en", 3), (3, "x" * 300_000, None, 3)], "doc_id long, text string, lang string, score long")
    model = L.learn(docs, dimensions=D)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[None][0] == "en" and got[3][0] == "en"
    nothing = L.learn(docs.limit(0))
    assert {r["lang_pred"] for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).collect() == []


def test_a_batch_of_long_texts_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    from isobath.llm.common import decoded, slices

    rng = np.random.default_rng(5)
    text = "".join(chr(97 + c) if c < 26 else " " for c in rng.integers(0, 30, 1 << 16))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 64)], names=["text"])  # 4 MB
    L.letters()
    tracemalloc.start()
    for part in slices(batch, 0, **L.PART):
        L.bundled(decoded(part.column(0)), L.DIMENSIONS)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 120 << 20
