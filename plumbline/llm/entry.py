"""The queries of the ten operators over the sample tables, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat_transcripts, decontaminate, html_extract, license_scan, quality, sentencepiece_lattice, setsketch_dedup, token_files, topk, warc
from plumbline.llm.common import table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), piece_model())


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), word_tokenizer())


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_transcripts.format_turns(table(spark, sf_dir, "conversations"))


def op10_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece_lattice": op1_sentencepiece_lattice,
    "op2_html_extract": op2_html_extract,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_files": op5_token_files,
    "op6_topk": op6_topk,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_chat_transcripts": op9_chat_transcripts,
    "op10_setsketch_dedup": op10_setsketch_dedup,
}

ORACLE_SQL = {
    "op3_warc": warc.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op6_topk": topk.SQL,
    "op7_license_scan": license_scan.sql(),
    "op9_chat_transcripts": chat_transcripts.SQL,
}
