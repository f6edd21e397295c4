"""Cleaning of the documents table, stage by stage, into token ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitledger.llm import decontamination, language, line_dedup, near_copies, pieces
from hitledger.llm.queries import language_model
from hitledger.llm.texts import BATCH_BYTES, table, work_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage, its rows sent to Python in batches of bounded bytes, and not of ten thousand rows whatever their size.

    The session keeps the setting: rows are sent when the result is written, after the stage has returned.
    """

    @wraps(stage)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_bounded


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; without a letter or in no such language they go."""
    return language.keep_identified(docs, language_model(docs))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share stay only in the document that showed them first."""
    kept = line_dedup.drop_common_lines(docs, keep_first=True)
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids."""
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", bounded(identified_language)),
    ("line_dedup", bounded(shared_lines)),
    ("near_duplicates", bounded(near_duplicates)),
    ("decontamination", bounded(benchmark_leaks)),
    ("sentencepiece", bounded(token_ids)),
]

#: Language models, fingerprints and token ids are beyond SQL; a test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        to = work_path(spark, f"pipeline-{at}-{name}")
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return docs
