"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

Every stage takes the documents that its predecessor kept and returns documents
of the same columns, but for the last, which returns packed pieces.  ``run``
writes each stage as a table and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm import decontaminate as dc
from vicinage.llm import language
from vicinage.llm.jaccard_join import jaccard_join
from vicinage.llm.line_dedup import line_dedup
from vicinage.llm.packing import pack
from vicinage.llm.store import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents; reject those without a recognised language, set ``lang`` of the rest.

    Null, empty and letterless texts go.  Ties between languages go to the first
    by name.  Repeated rows and null ids are kept as they are.
    """
    model = language.learn(docs)
    got = language.identify(docs, model, keep=("text", "source", "n_chars")).filter(F.col("lang_pred") != language.UNKNOWN)
    return got.select(F.col("id").alias("doc_id"), "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def remove_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites go but for the document with the smallest id; ``n_chars`` follows the text.

    No row goes: a text of nothing but such lines becomes empty.  A null source is
    a site of its own, a null id counts as the largest, a null text stays null.
    """
    got = line_dedup(docs.select(*COLUMNS))
    return got.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity 0.8 or more; of each component the document with the smallest id stays.

    Empty and null texts link with nothing and stay.  Rows are told apart by id
    and text, so a second text under an id stays where the first one goes; rows
    alike in both are one document.  A null id is larger than all others: such
    rows go if their component has a row with an id, and stay else.
    """
    found = jaccard_join(docs, percent=80, width=5).filter(~F.col("id").eqNullSafe(F.col("component_id")))
    gone = found.select(F.struct("id", "th").alias("_gone")).distinct()
    rows = docs.select(*COLUMNS).withColumn("_row", F.struct(F.col("doc_id").cast("long").alias("id"), _text_hash().alias("th")))
    kept = rows.join(gone, F.col("_row").eqNullSafe(F.col("_gone")), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of the table ``benchmark`` go, by id and text, null ids too.

    Null and empty texts overlap nothing and stay; an empty benchmark removes nothing.
    """
    return dc.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; a null or empty text is its end id; every row is packed on its own."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_boilerplate_lines),
    ("jaccard_join", remove_near_duplicates),
    ("decontamination", remove_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Mixture models, sketches and a tokenizer are beyond SQL; tests/llm hold the filtering stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's table stays in the shared folder until ``store.release``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
