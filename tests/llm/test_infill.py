import datetime
import hashlib

import pytest

from isobath.llm import infill as M
from isobath.llm.queries import op11_fill_in_middle

SF = "/root/testdata/sf0.001"


def brute(doc_id, text, rate=90, spm=20):
    """n, form, prefix, middle and suffix by slices of one text."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(text) + 1) for x in h[:2])
    plain = not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate
    return len(text), "plain" if plain else "spm" if h[3] % 100 < spm else "psm", text[:a], text[a:b], text[b:]


def wanted(doc_id, text, **how):
    n, form, p, m, s = brute(doc_id, text, **how)
    output = {"plain": text or "", "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), output


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = op11_fill_in_middle(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        *own, output = wanted(r.doc_id, docs[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == own and r.output_sha256 == sha(output) and r.restored_sha256 == sha(docs[r.doc_id] or "")


ODD = ["", None, "a", "a<P>b", "<S>", "<M", "<P", "P>S>M>", "<<<<", "<P<S<M", "é😀́\n\r\x00\t" * 50, "x" * 3_000_000, "\n", "same", "same", "​  "]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i // 2 if i % 5 else None, t, 7) for i, t in enumerate(ODD * 8)], "doc_id long, text string, form int").repartition(3)
    made = M.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: [str(x) for x in r]
    expected = [(i // 2 if i % 5 else None, *wanted(i // 2 if i % 5 else None, t)) for i, t in enumerate(ODD * 8)]
    assert sorted(map(tuple, made.collect()), key=key) == sorted(expected, key=key)
    back = M.restored(made).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=key) == sorted([(i // 2 if i % 5 else None, t or "") for i, t in enumerate(ODD * 8)], key=key)
    assert len({r[2] for r in expected}) == 3


def test_rates_and_other_ids(spark):
    rows = [(f"doc {i}", f"text number {i} of some length") for i in range(200)]
    made = M.fill_in_middle(spark.createDataFrame(rows, "name string, body string"), "name", "body", rate=50, spm=100).collect()
    assert {r.name: tuple(r)[1:] for r in made} == {i: wanted(i, t, rate=50, spm=100) for i, t in rows}
    dates = spark.createDataFrame([(datetime.date(2020, 1, 2), "some words")], "doc_id date, text string")
    assert M.fill_in_middle(dates).first().output == wanted("2020-01-02", "some words")[-1]


def test_empty_table_and_outputs_of_no_text(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    bad = spark.createDataFrame([(1, "psm", "<P>a<M>b"), (2, "spm", "<P>a<S>b<M>c"), (3, "psm", None), (4, "psm", "<P>a<S>b<M>c")], "doc_id long, form string, output string")
    assert [r.text for r in M.restored(bad).orderBy("doc_id").collect()] == [None, None, None, "acb"]


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert M.fill_in_middle(docs).first().n == 3


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_borders_look_like_sentinels(spark, form):
    parts = ["<", "<S", "S>", ">", "", "P>", "<M", "M>"]
    rows = [(p, m, s) for p in parts for m in parts for s in parts if not any(x in p + m + s for x in ("<P>", "<S>", "<M>"))]
    outputs = [(p + m + s, form, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}") for p, m, s in rows]
    assert all(r.text == r.doc_id for r in M.restored(spark.createDataFrame(outputs, "doc_id string, form string, output string")).collect())
