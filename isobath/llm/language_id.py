"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A trigram's vector binds
its letters' vectors, permuted by their place: rotate(a, 2) * rotate(b, 1) * c.  A document is the
bundle (sum) of its trigrams' vectors, a language the bundle of its documents, each weighted by the
reciprocal of its trigrams so that long ones don't rule.  A document is given the language whose
prototype has the largest cosine with it.

Words are runs of letters (``str.isalpha``) of the lower-cased text; a boundary is a symbol of its
own, and trigrams never cross texts.  Tasks bundle their own documents, so one integer vector per
task and language is shuffled, over ``SALTS`` parts of each language; the model on the driver is
one vector per language.

Defined results: null text or text without a letter is ``und`` with score 0, as is any text where
nothing was learned; ties go to the first language in order; rows without language teach nothing;
rows are independent, so repeated rows give repeated results; very long texts are read whole, in blocks;
an empty table gives no rows; other columns of the input aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm.common import arrow_type, decoded, slices, text_rows

DIMENSIONS = 1024
SEED = 7919
UNDETERMINED = "und"
SALTS = 16
#: Bundles are summed as integers, so the sum doesn't depend on its order.
UNIT = float(1 << 32)
GRAMS, DOCS = 4096, 256
#: Most bytes of texts, unless one is longer, and most rows that are bundled at a time: a worker needs about 60 bytes for each of the first.
PART = {"most": 1 << 20, "rows": 4096}


def held_out(id_col: str) -> Column:
    """Rows that are kept from learning; a row without id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


class Model(NamedTuple):
    languages: list[str]
    prototypes: np.ndarray
    dimensions: int


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1 << 14)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return (np.random.default_rng((SEED, code)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams (code points, 0 a boundary), and per occurrence its index and its text."""
    lower = [x.lower() for x in texts]
    points = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) + 1 for x in lower])
    text = np.concatenate([np.zeros(1, np.int32), text])
    letter = letters()[points]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # of a run of others one stays
    points, text, letter = np.where(letter, points, 0)[keep], text[keep], letter[keep]
    if len(points) < 3:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    seen[0] = True
    alphabet = np.flatnonzero(seen)
    k = len(alphabet)
    place = np.zeros(0x110000, np.int32 if k**3 < 1 << 31 else np.int64)
    place[alphabet] = np.arange(k)
    symbol = place[points]
    gram = (symbol[:-2] * k + symbol[1:-1]) * k + symbol[2:]
    # around a letter a trigram is its text's own; around a boundary both neighbours must be
    own = letter[1:-1] | (text[:-2] == text[2:]) & letter[2:] & letter[:-2]
    gram, text = gram[own], text[1:-1][own]
    if k**3 <= 1 << 23:
        present = np.zeros(k**3, bool)
        present[gram] = True
        distinct = np.flatnonzero(present)
        index = np.zeros(k**3, np.int32)
        index[distinct] = np.arange(len(distinct))
        index = index[gram]
    else:
        distinct, index = np.unique(gram, return_inverse=True)
    return np.stack([alphabet[distinct // (k * k)], alphabet[distinct // k % k], alphabet[distinct % k]], axis=1), index, text


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    alphabet, place = np.unique(grams, return_inverse=True)
    place = place.reshape(grams.shape)
    vectors = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
    return (np.roll(vectors, 2, axis=1)[place[:, 0]] * np.roll(vectors, 1, axis=1)[place[:, 1]] * vectors[place[:, 2]]).astype(np.float32)


def bundled(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bundle, and its number of trigrams."""
    grams, index, text = trigrams(texts)
    out = np.zeros((len(texts), dimensions), np.float32)
    for first in range(0, len(grams), GRAMS):
        block = grams[first : first + GRAMS]
        vectors = gram_vectors(block, dimensions)
        inside = slice(None) if len(grams) <= GRAMS else (index >= first) & (index < first + len(block))
        own_index, own_text = index[inside] - first, text[inside]
        for begin in range(0, len(texts), DOCS):
            a, b = np.searchsorted(own_text, (begin, begin + DOCS))
            n = min(DOCS, len(texts) - begin)
            counts = np.bincount((own_text[a:b] - begin) * len(block) + own_index[a:b], minlength=n * len(block)).reshape(n, -1)
            out[begin : begin + n] += counts.astype(np.float32) @ vectors
    return out, np.bincount(text, minlength=len(texts))


def weighted(texts: list[str], labels: np.ndarray, classes: int, dimensions: int) -> np.ndarray:
    """Per class the sum of its texts' bundles, each divided by its number of trigrams."""
    grams, index, text = trigrams(texts)
    out = np.zeros((classes, dimensions))
    weight = 1.0 / np.maximum(np.bincount(text, minlength=len(texts)), 1)
    sums = np.bincount(labels[text] * len(grams) + index, weights=weight[text], minlength=classes * len(grams)).reshape(classes, -1) if len(grams) else out[:, :0]
    for first in range(0, len(grams), GRAMS):
        out += sums[:, first : first + GRAMS] @ gram_vectors(grams[first : first + GRAMS], dimensions)
    return out


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> Model:
    """Prototypes of the languages of ``docs``."""
    rows = text_rows(docs, lang_col, text_col).select("text", F.col("id").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0, **PART):
                names, labels = np.unique(np.array(part.column(1).to_pylist(), object), return_inverse=True)
                sums = weighted(decoded(part.column(0)), labels, len(names), dimensions)
                for name, own in zip(names.tolist(), sums, strict=True):
                    total[name] = total.get(name, 0) + np.rint(own * UNIT).astype(np.int64)
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([salt] * len(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["lang", "salt", "bundle"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(dimensions, np.int64)
        for own in frame["bundle"]:
            total += np.frombuffer(own, np.int64)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "bundle": [total.tobytes()]})

    found: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(bundle, "lang string, salt int, bundle binary").groupBy("lang", "salt").applyInPandas(add, "lang string, bundle binary").collect():
        found[r["lang"]] = found.get(r["lang"], 0) + np.frombuffer(r["bundle"], np.int64)
    languages = sorted(found)
    prototypes = np.array([found[x] / UNIT for x in languages], np.float64).reshape(len(languages), dimensions)
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Model(languages, (prototypes / np.where(norms > 0, norms, 1)).astype(np.float32), dimensions)


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    vectors, n = bundled(texts, model.dimensions)
    none = [not m for m in n.tolist()]
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    norms = np.linalg.norm(vectors, axis=1)
    cosines = (vectors @ model.prototypes.T).astype(np.float64) / np.where(norms > 0, norms, 1)[:, None]
    best = cosines.argmax(axis=1)
    score = np.clip(cosines[np.arange(len(texts)), best], 0.0, 1.0)
    score[none] = 0.0
    return [UNDETERMINED if x else model.languages[i] for x, i in zip(none, best.tolist(), strict=True)], score


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per row of ``docs``: id, ``lang_pred`` and ``score``, the cosine with its prototype (0 at least).

    With ``carry`` the whole row comes along, as the struct ``doc`` in place of the id.
    """
    first = F.struct("*").alias("doc") if carry else F.col(id_col).alias(id_col)
    rows = docs.select(first) if carry else docs.select(first, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    known = docs.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shape = known.value, arrow_type(schema)
        for batch in batches:
            text = batch.column(0).field(text_col) if carry else batch.column(1)
            both = pa.RecordBatch.from_arrays([batch.column(0), text], names=["row", "text"])
            for part in slices(both, 1, **PART):
                languages, score = predict(decoded(part.column(1)), own)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages, pa.string()), pa.array(score)], schema=shape)

    return rows.mapInArrow(classify, schema)
