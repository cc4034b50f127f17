"""A training corpus from documents, in five stages, each of which works on what the one before it kept.

1. quality: documents that the compression classifier scores below 0.7 go;
2. near_duplicates: of documents that the n-gram Jaccard join connects, at 0.8 on shingles of five words, the one of the smallest id stays;
3. decontamination: documents that hold a benchmark item, in whatever order, go;
4. pii: personal data is replaced by its kind, and n_chars follows;
5. mixing: every document gets the rate that brings the corpus to the target weights.

All stages but the last return the five columns of documents; others are left out,
whatever their names. Rows are judged one by one: repeated rows stay or go together,
and nulls in the other columns don't matter. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import compression, jaccard_join, mixing, pii, tiling
from auditloom.llm.common import discard, held_out, small_or_not, stored, table


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle and percent of the union from which on two documents are near duplicates; op6 has its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a score of 0.7 or more; the classifier learns from the given documents that labels has.

    A null text scores as the empty one; long texts are read whole.
    """
    model = compression.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return compression.score(docs.select(*COLUMNS), model).filter("score >= 0.7").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of the smallest id. Rows that repeat an id stay or go together; a null id, a null text and a text without words stay."""
    joined = jaccard_join.join(docs, NEAR_WORDS, NEAR_PERCENT)
    gone = stored(joined.filter("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(small_or_not(gone), "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold less than half of every benchmark item; null and empty texts hold nothing, and an empty benchmark rejects nothing."""
    return tiling.judge(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by <EMAIL>, <IP>, <CARD> or <PHONE> and n_chars counted anew; a null text stays null, with null n_chars."""
    return pii.mask(docs.select(*COLUMNS), pii.train(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, domain posteriors and rate of every document that is left; null and blank texts have no tokens and rate 1."""
    return mixing.mix(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("mixing", mix)]

#: No stage but decontamination could be written in SQL, so the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return docs
