"""Retrieval collections in the usual folder form: corpus.jsonl, queries.jsonl and qrels/<split>.tsv."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens


def default_split(dataset: str) -> str:
    """Collections named msmarco... are evaluated on dev, others on test."""
    return "dev" if dataset.startswith("msmarco") else "test"


def resolve(name: str, given: str | None, variable: str, default: str) -> str:
    """Folder of a collection: the argument, else the environment, else the default."""
    return f"{(given or os.environ.get(variable) or default).rstrip('/')}/{name}"


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    return rows.select(F.col("_id").alias("did"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def load_queries(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """Queries; with ``split`` those that it judges."""
    rows = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("qid"), "text")
    return rows if split is None else rows.join(load_qrels(spark, folder, split).select("qid").distinct(), "qid", "left_semi")


def load_qrels(spark: SparkSession, folder: str, split: str) -> DataFrame:
    rows = spark.read.option("header", True).option("sep", "\t").schema("qid string, did string, rel int").csv(f"{folder}/qrels/{split}.tsv")
    return rows.filter("qid is not null and did is not null")


def load(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, judged queries and judgements of a split."""
    return load_corpus(spark, folder), load_queries(spark, folder, split), load_qrels(spark, folder, split)


def load_single_vectors(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(id, sv); with ``keys``, ids without a vector or without a key are an error."""
    rows = spark.read.parquet(path).withColumn("sv", F.col("sv").cast("array<float>"))
    if keys is not None:
        lone = rows.select(F.col("id").alias(key)).join(keys.select(key), key, "left_anti").count() + keys.select(key).join(rows.select(F.col("id").alias(key)), key, "left_anti").count()
        if lone:
            raise ValueError(f"{lone} ids have a vector or a key, not both")
    return rows


def load_embeddings(spark: SparkSession, root: str, dataset: str, mv_encoder: str, sv_encoder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Corpus bags and single vectors, then those of the split's queries.

    They lie at ``root/dataset/<encoder>/{corpus,query}{suffix}_{mv,sv}``, as parquet with columns (id, vecs) or (id, sv).
    """
    suffix = tokens.split_suffix(split)
    bags = lambda side: tokens.load_bags(spark, f"{root}/{dataset}/{mv_encoder}/{side}_mv")
    single = lambda side: load_single_vectors(spark, f"{root}/{dataset}/{sv_encoder}/{side}_sv")
    return bags("corpus"), single("corpus"), bags(f"query{suffix}"), single(f"query{suffix}")
