"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, and its decisions take effect; all but the last return
the columns of the documents, whatever these are besides ``doc_id``, ``text`` and ``lang``.  Between
stages the documents are written to the shared folder.  What a stage returns rests on its documents and
on the keys that it drops; all else that it wrote is deleted before it returns.

Rows are told apart by id and text, so documents that share an id are judged each for itself, and
rows that repeat both are one document from exact deduplication on.  Null ids are ids like others.
Every stage gives no rows for an empty table, judges texts whole however long they are, and keeps
columns of any other name as they are.  What a null or empty text comes to is said per stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.llm.common import fresh_path, kept, scratch, table
from isobath.llm.decontaminate import find_contained
from isobath.llm.exact_dedup import equal_texts
from isobath.llm.language_id import held_out, identify, learn
from isobath.llm.packing import sequences
from isobath.llm.similar import near_copies

#: Languages that stay; None: all that were learned.
LANGUAGES: tuple[str, ...] | None = None


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a struct of id and text hash, under a name that no column has."""
    name, taken = "key", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return docs.select("*", F.struct(F.col("doc_id"), F.xxhash64("text").alias("print")).alias(name)), name


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in column ``dropped`` of ``dropped``."""
    rows, key = keyed(docs)
    gone = dropped.select(F.col("dropped").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of ``LANGUAGES`` whose prototype they resemble more than chance does.

    Prototypes are learned from the labelled documents that are not held out.  A document stays if
    its best language is wanted and its cosine is ``4 / sqrt(dimensions)`` or more: less is what a
    bundle of letters unrelated to any learned language reaches too (four standard deviations of a
    random cosine).  Null texts and texts without a letter have no language and go.  Where nothing was
    learned, everything stays.
    """
    model = learn(docs.where(~held_out("doc_id")))
    if not model.languages:
        return docs
    found = identify(docs, model, carry=True)
    wanted = F.col("lang_pred").isin(*(LANGUAGES or model.languages))
    return found.where(wanted & (F.col("score") >= 4 / model.dimensions**0.5)).select("doc.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the largest id, of each group of equal texts; null and empty are equal."""
    rows, key = keyed(docs)
    found = kept(spark, "equal", lambda: equal_texts(rows.select(key, "text"), key).select(F.col(key).alias("dropped"), "kept"))
    left = without(docs, found.where("NOT kept"))
    repeated = found.where("kept").groupBy("dropped").count().where("count > 1").select("dropped")
    if repeated.isEmpty():
        return left
    rows, key = keyed(left)
    again = rows.join(repeated.withColumnRenamed("dropped", key), key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return without(left, repeated).union(again)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each component of texts whose five-word shingles have a similarity of 0.8 or more.

    Texts without a word, null ones too, are alike.
    """
    rows, key = keyed(docs)

    def later() -> DataFrame:
        found = near_copies(rows.select(key, "text"), key)
        return found.where(~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("dropped"))

    return without(docs, kept(spark, "near", later))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and without items all stay."""
    rows, key = keyed(docs)
    found = find_contained(rows.select(key, "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), id_col=key)
    return without(docs, found.select(F.col(key).alias("dropped")))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed sequence, with the documents' ids and texts in order; a null text is an empty piece."""
    import public_tokenizers

    return sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("best_fit", best_fit),
]

#: Prototypes, near copies and packing need more than SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with scratch(spark):  # what a stage wrote for itself goes once its documents are written
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
