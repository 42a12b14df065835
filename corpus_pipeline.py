"""From raw documents to packed token sequences: five stages, each one operator over all rows.

language   documents whose language is not recognised go
lines      lines that match an earlier line go, and documents of which nothing is left
near       one document of each group of near-duplicates stays
mix        documents are repeated or left out, so that sources come near their target sizes
pack       the rest is tokenized, cut and packed; one row per piece

Each stage reads what the one before kept, written as Parquet to the shared folder. All but the
last return the columns they were given. Nulls, empty texts, ties, repeated rows, empty tables and
further columns fare as the operators' modules define. `ORACLE_SQL` is None: tokenizing, hashing
into sketches and the random draws of the mix are not SQL; the tests compare each stage with a
brute-force version or its contract.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchlens.llm import language, lines, mixing, near, packing, store


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.recognised(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.deduplicated(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("lines", without_repeated_lines),
    ("near", without_near_duplicates),
    ("mix", mixed),
    ("pack", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store.staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
