"""From raw documents to packed training sequences: language ID, near duplicates, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantloom.llm.common import held_out, q, stored, table
from plantloom.llm.lang import fit_languages, identify_languages
from plantloom.llm.mix import mix_sources
from plantloom.llm.near import first_of_class
from plantloom.llm.pack import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that have no language: NULL, empty and letterless texts.

    The model learns from the labelled rows outside the held-out fifth; every other document stays
    as it is, whatever its language.
    """
    model = fit_languages(docs.where(~held_out(F.col("doc_id"), 5)))
    found = identify_languages(docs, model)
    return found.where("lang_pred <> 'und'").select(*[q(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near duplicates (5 words, 0.8)."""
    return first_of_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; documents taken 0 times go.

    NULL and blank texts have no words and go; a NULL source is a source like any other; ties,
    repeated rows and long texts as in ``mix_sources``. An empty table stays empty.
    """
    mixed = mix_sources(docs)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_repeats"))).alias("_time")
    return mixed.where("_repeats > 0").select("*", times).select(*[q(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents placed in sequences of 2048 tokens.

    A NULL text is an empty one, long texts are cut; columns but the id and the text are dropped.
    """
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("mix", mix),
    ("pack", pack),
]

# Likelihoods, MinHash classes, flows and token ids have no SQL form; tests/llm checks run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written as Parquet and read by the next.

    An empty table gives no rows; columns that a stage does not know pass through all but the last.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
