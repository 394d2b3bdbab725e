"""The corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import arrow_batches, cut, free, table
from graphloom.llm.exact_dedup import drop_exact_copies
from graphloom.llm.mixing import take_mix
from graphloom.llm.near_dup import BATCH_BYTES, drop_near_duplicates
from graphloom.llm.packing import pack
from graphloom.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic; the model learns from the labels of sf_dir."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: a row for every time that one is taken."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: bucket, batch and slot."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The toxicity score and the near-duplicate classes aren't expressible in SQL; tests hold brute-force versions against run().
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written and read again, and removed when the next one's are written.

    Null and empty texts are documents like others, repeated rows are copies, and an empty table gives
    an empty result; each stage's operator states how it treats them.
    """
    docs = table(spark, sf_dir, "documents")
    with arrow_batches(spark, BATCH_BYTES):
        for name, stage in STAGES[:-1]:
            kept = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            free(docs)
            docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
