"""The corpus pipeline: quality rules, line dedup, one of each group of near copies, sanitised texts, packed sequences.

Each stage takes all that its predecessor kept. Scratch tables are deleted when a stage begins and no DataFrame is built on them any more; so results of
this and of other runs stay readable as long as somebody holds them. ``ORACLE_SQL`` is None: SQL expresses neither tokenisers nor packing; the
tests hold run() against a brute-force version.

Nulls and defects: a document with a null or empty text fails the quality rules and goes; a null language falls to the script; a null doc_id sorts before all others;
rows that repeat each other share one verdict, and one of them stays in the third stage. Texts of any length are taken whole. ``n_chars``
follows the text where there is such a column; other columns pass unchanged through the first four stages. An empty table gives no sequences.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagfold.llm import disclosure, fertility, lines, ngram_join, packing
from bagfold.runtime import drop_unread, materialize

ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tidy(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_unread(spark)
        return stage(spark, docs, sf_dir)

    return run


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@_tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fertility.keep_fit(docs, public_tokenizers.path("piece_bpe_32k.model"))


@_tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(lines.line_dedup(docs))


@_tidy
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, k=5, percent=80)


@_tidy
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(disclosure.sanitise(docs))


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
