"""Corpus pipeline over `documents`: quality, near-duplicates, decontamination, token ids.

Every stage is a function (spark, docs, sf_dir) of the documents that the stage before it kept; all but the last return
the columns of documents. `run` writes each stage's rows as Parquet in the shared folder and reads them again.

Nulls, empty texts, repeated rows and empty tables: as the operators define them. A null text is scored as empty; rows
without a doc_id pass near-duplicate removal; a document that holds a benchmark item goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, quality, sentencepiece_lattice, setsketch_dedup
from plumbline.llm.common import cut, table
from plumbline.llm.entry import piece_model


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode(docs, piece_model())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("sentencepiece", token_ids),
]

#: The classifier has no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
