"""From raw documents to packed training sequences; each stage is one of the operators in nightframe.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from nightframe.llm import exact_dedup, packing, pii, quality, simhash
from nightframe.llm.common import shared_dir, table, temporary

#: Neither nearest-neighbour votes nor keyed surrogates nor best fit can be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents call good. Null and empty texts get the share of good labels as score;
    repeated rows are judged alike; an empty table, or one without labels, passes."""
    return quality.keep_good(docs, quality.quality_model(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; null and empty texts are one text, of rows that repeat id and text one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more. Texts without words
    and rows without an id stay."""
    return simhash.drop_near_duplicates(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data; null and empty texts stay as they are."""
    return pii.replace_pii(docs, pii.pii_key(spark)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or piece of one, lies in the training sequences; null and empty texts lie in none. The texts
    are those of the stage before."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", surrogates), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    """All stages, one after the other; what each returns is written under its name into ``out`` and read again.

    ``out`` (a new folder in the shared one if it isn't named) keeps what every stage left: the texts to train on are in
    ``out``/pii, their places in ``out``/packing. What the operators write meanwhile is deleted.
    """
    docs, out = table(spark, sf_dir, "documents"), out or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with temporary(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(f"{out}/{name}")
        docs = spark.read.schema(found.schema).parquet(f"{out}/{name}")
    return docs
