"""From raw documents to packed sequences: five stages, each written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm import decontamination, language, near_duplicates, ordinal, packing
from ballast.llm.common import crc_mod, pinned, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with P(grade >= 1) of one half or more."""
    grades = ordinal.grades_of(table(spark, sf_dir, "labels"))
    return ordinal.accepted(docs, ordinal.fit(docs, grades, 3))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, by the scores of right answers for it."""
    return language.accepted(docs, language.fit(docs, crc_mod(F.col("doc_id"), 3) != 1))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_duplicates.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in benchmark passages."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in sequences of 1024 tokens."""
    return packing.pack(pinned(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("language", languages),
    ("near_duplicates", near_copies),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: Models and packing are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
