"""Corpus pipeline: language, host quality, near duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loamgrid.llm import bottom_k, curve_packing, host_rules, language_codes, prefix_doubling
from loamgrid.session import ship_package, write_and_read


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language shows; null texts and texts without a letter go."""
    ship_package(spark)
    return language_codes.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes."""
    ship_package(spark)
    return host_rules.keep_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id."""
    ship_package(spark)
    return bottom_k.keep_one_each(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what a document with a smaller id says in 50 bytes or more."""
    ship_package(spark)
    return prefix_doubling.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, one row each."""
    ship_package(spark)
    return curve_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [("language_id", known_language), ("quality_rules", good_quality), ("near_duplicates", one_of_each), ("repeated_passages", no_repeats), ("packing", packed)]

#: Learned languages, similarity components and subword ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
