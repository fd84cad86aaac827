import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from isobath.llm import token_counts as K
from isobath.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SPLITTER = K.Splitter(open(PATH, encoding="utf-8").read())


def exact(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


def summed(text):
    pre, special = SPLITTER(text)
    return special + sum(SPLITTER.pieces(pre))


TEXTS = [None, "", " ", "\n\n  a", "it's we'll 'S  'the", "<|endoftext|>a<|endoftext|><|endoftext|>", "x <|endoftext|> y<|endoftext", "a" * 20_000, "1234 ５ ½ x²", "été naïve    z\x85\x1c\x1d", "漢字かな 한국어 \U0001f600\U0001f600 ok", "՘࢏Ᲊ tail", " \t \r\n'd'"]


@pytest.mark.parametrize("text", TEXTS[1:])
def test_split_texts_count_as_the_library_does(text):
    assert summed(text) == exact(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abc '’sdtmrvel<|>endoftxt 12 \n\t\r\x0b\x1c\x85\xa0"), st.characters(exclude_categories=["Cs"]))))
def test_any_text_counts_as_the_library_does(text):
    assert summed(text) == exact(text)


def test_settled_blocks_split_alike():
    for begin, end in K.SETTLED:
        for first in range(begin, end + 1, 64):
            text = "".join(f"a{c}1{c}!{c}  {c}{c} b" for c in map(chr, range(first, min(first + 64, end + 1))))
            assert not SPLITTER.unsettled.search(text)
            assert SPLITTER.split.findall(text) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("frequent", [0, 20, 1 << 20])
def test_counts_whichever_way_pre_tokens_are_looked_up(spark, frequent):
    rows = [*enumerate(TEXTS), (3, "again again"), (3, "again again"), (None, "no id")]
    got = K.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, frequent=frequent).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, len((t or "").encode()), exact(t)) for i, t in rows), key=key)


def test_query_against_the_library(spark):
    from isobath.llm.queries import op4_token_counts

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = op4_token_counts(spark, sf).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in got} == {i: (exact(t), exact(t) > 1024) for i, t in texts.items()} and len(got) == len(texts)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, row string, n long")
    assert K.count_tokens(docs, PATH).columns == ["doc_id", "n_bytes", "n_tokens"]
    assert K.count_tokens(docs.limit(0), PATH).collect() == []
