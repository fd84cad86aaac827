import pathlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as P
from isobath.llm import language_id
from isobath.llm.common import table
from isobath.sources.staging import shared_folder
from tests.llm.test_decontaminate import brute as brute_contained
from tests.llm.test_exact_dedup import lower
from tests.llm.test_similar import brute_components

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, items):
    """(id, text) of the documents after all filtering stages, from (id, text, lang) rows."""
    model = brute_model(docs)
    docs = [(d, t) for d, t, _ in docs if brute_score(t, model) >= 4 / language_id.DIMENSIONS**0.5]
    best = {}
    for d in docs:
        best[lower(d[1])] = max(d, best.get(lower(d[1]), d))
    label = brute_components(sorted(best.values()))
    docs = [d for d in sorted(best.values()) if label[d[0]] == d[0]]
    bad = {d for d, *_ in brute_contained(docs, items)}
    return [d for d in docs if d[0] not in bad]


def bundle(text):
    """Letter by letter: rotate(a, 2) * rotate(b, 1) * c of every trigram of the text's runs."""
    symbols = [0]
    for c in text.lower():
        if c.isalpha() or symbols[-1]:
            symbols.append(ord(c) if c.isalpha() else 0)
    symbols += [0] if symbols[-1] else []
    vectors = [language_id.letter_vector(s, language_id.DIMENSIONS).astype(float) for s in symbols]
    grams = [np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(vectors, vectors[1:], vectors[2:])]
    return sum(grams, np.zeros(language_id.DIMENSIONS)), len(grams)


def brute_model(docs):
    model = {}
    for d, text, lang in docs:
        if zlib.crc32(str(d).encode()) % 5 and text and lang:
            v, n = bundle(text)
            model[lang] = model.get(lang, 0) + v / max(n, 1)
    return model


def brute_score(text, model):
    v, n = bundle(text or "")
    return max(v @ m / np.linalg.norm(v) / np.linalg.norm(m) for m in model.values()) if n else 0.0


def test_run_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    left = brute(docs, items)
    found = {}
    for r in P.run(spark, SF).collect():
        for d, k, t in zip(r["doc_ids"], r["pieces"], r["texts"], strict=True):
            found.setdefault(d, []).append((k, t))
    assert {d: "".join(t for _, t in sorted(x)) for d, x in found.items()} == dict(left) and 0 < len(left) < len(docs)


def test_language_stage_acts_on_the_score(spark):
    english = ["the quick brown fox jumps over the lazy dog and runs away", "there was a time when the people of this town would gather"]
    rows = [(i, f"{english[i % 2]} {i}", "en", "a", 1) for i in range(40)] + [(100, "ЖЩЪ ЫЭЮ ЯЖЩ ЪЫЭ ЮЯЖ ЩЪЫ ЭЮЯ", None, "a", 1), (101, "the people of the town", None, "a", 1)]
    kept = {r["doc_id"] for r in P.language_id(spark, spark.createDataFrame(rows, COLUMNS), SF).collect()}
    assert kept == {*range(40), 101}


def test_column_names_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "some words of a text", "en", 7, 8, 9, 1), (2, "other words of a text", "en", 7, 8, 9, 2)], "doc_id long, text string, lang string, __key int, key int, print int, n int")
    for _, stage in P.STAGES[:-1]:
        assert sorted(stage(spark, docs, SF).collect()) == sorted(docs.collect())
    assert sum(len(r["doc_ids"]) for r in P.best_fit(spark, docs, SF).collect()) == 2


ROWS = [
    (1, "The same old text", "en", "a", 17),
    (2, "the SAME old text", "en", "a", 17),
    (2, "the SAME old text", "en", "a", 17),
    (3, None, "en", None, None),
    (4, "12 34", None, None, None),
    (4, "A text of another row", None, None, None),
    (None, "nameless words here", "fr", None, None),
    (None, "nameless words here", "fr", None, None),
]


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, COLUMNS)
    first = P.language_id(spark, docs, SF)
    assert sorted(r["doc_id"] or 0 for r in first.collect()) == [0, 0, 1, 2, 2, 4] and first.columns == docs.columns
    second = P.exact_dedup(spark, first, SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in second.collect()) == [(0, "nameless words here"), (2, "the SAME old text"), (4, "A text of another row")]
    third = P.simhash_dedup(spark, second, SF)
    assert third.count() == 3 and third.columns == docs.columns
    assert P.decontaminate(spark, third, SF).count() == 3
    assert sum(len(r["doc_ids"]) for r in P.best_fit(spark, third, SF).collect()) == 3


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_on_an_empty_table(spark, stage):
    assert stage(spark, spark.createDataFrame([], COLUMNS), SF).collect() == []


def test_near_duplicates_leave_one(spark):
    words = " ".join(f"word{i}" for i in range(4000))
    rows = [(5, words, "en", "a", 1), (3, words.replace("word2000 ", "other "), "en", "a", 1), (9, "quite another text of its own", "en", "b", 1)]
    left = P.simhash_dedup(spark, spark.createDataFrame(rows, COLUMNS), SF)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 9]


def test_language_rejects_only_what_has_no_letter():
    model = language_id.Model([], None, 8)
    assert language_id.predict(["", "1"], model)[0] == ["und", "und"]


@pytest.mark.parametrize("stage", [P.exact_dedup, P.simhash_dedup])
def test_stages_leave_keys_only_in_the_shared_folder(spark, stage):
    """Tables that outlive a stage add up over the pipeline: none but the keys it drops, whoever calls it."""
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:")) / "isobath"
    files = lambda: {f for f in folder.rglob("*.parquet") if f.is_file()}
    docs = table(spark, SF, "documents")
    before = files()
    left = stage(spark, docs, SF)
    new = files() - before
    assert 0 < sum(f.stat().st_size for f in new) < 0.1 * sum(len((r["text"] or "").encode()) for r in docs.collect())
    assert all("text" not in pq.read_schema(f).names for f in new) and len({f.parent for f in new}) == 1
    assert 0 < left.count() < docs.count()
