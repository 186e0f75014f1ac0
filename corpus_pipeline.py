"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the
shared folder and read back as the next one's docs. All stages but the last return the columns
of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import lines, near_dup, packing, quality, toxicity
from ledgerlens.llm.queries import (
    QUALITY_LEAST,
    QUALITY_PARTS,
    TOXIC_MOST,
    TOXIC_PARTS,
    table,
    taught,
)
from ledgerlens.llm.ship import ship
from ledgerlens.session import durable


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, taught(spark, sf_dir, "quality", QUALITY_PARTS))
    return quality.accepted(docs, model, QUALITY_LEAST)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger does not reject."""
    model = toxicity.fit(docs, taught(spark, sf_dir, "toxic", TOXIC_PARTS))
    return toxicity.accepted(docs, model, TOXIC_MOST)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source."""
    return lines.cleaned(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    ship(spark)
    return near_dup.first_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("line_dedup", without_boilerplate),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]
ORACLE_SQL = None  # models and packing are not expressible in SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
