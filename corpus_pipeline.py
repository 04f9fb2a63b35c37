"""The corpus pipeline: documents of a known language, without repeated lines and near copies, mixed by source and packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoweft.llm import langid, lines, mixing, packing, simhash
from geoweft.llm.common import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; a text that is null, without a letter or of no sure language goes."""
    return langid.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines that stand, nearly alike, in an earlier document or place."""
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated whole or in part, so that sources meet their target weights."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, remembered=8 << 20)  # its workers share their memory with the stages before


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packed", packed)]

#: Naive Bayes, MinHash, SimHash and the tokenizer can't be expressed in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
