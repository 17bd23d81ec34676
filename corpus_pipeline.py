"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import decontam, langid, linededup, mixing, shingles
from revlens.llm.common import Scratch, held_out

MIN_MARGIN = 0.002


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told by a clear margin; learns from the labelled ones of the training fold.

    Null, empty and letterless texts go, as does everything where no label is to learn from. Repeated rows fare alike.
    """
    known = docs.where(~held_out(F.col("doc_id"), 4, 2))
    seen = langid.identify(docs, langid.fit_dictionaries(known), MIN_MARGIN)
    return seen.where(~F.col("rejected")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that match an earlier one; documents with none left go. Null and empty texts stay as they are."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group linked by Jaccard similarity of 0.8 of five-word shingles.

    Repeated rows of a kept id, and rows without an id, stay.
    """
    return shingles.near_dedup(docs, 0.8, 5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none, and null items are held by none."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, by which each source takes about its target's words; adds the columns of the mix and ``copy``."""
    return mixing.emit(mixing.mix(docs))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("mixture", mixture),
]
ORACLE_SQL = None  # compression sizes and hash fingerprints can't be had in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs
