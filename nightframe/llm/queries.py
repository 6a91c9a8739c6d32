"""The registered queries of the corpus operators and their DuckDB SQL, where there is any."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.llm import exact_dedup, jaccard_join, langid, negatives, packing, pieces, pii, quality, simhash, tiff, toxicity, url_filter, whitening
from nightframe.llm.common import table

#: A public vocabulary for op7; another one can be named in the environment. It is read on the driver and broadcast.
PIECE_MODEL = os.environ.get("NIGHTFRAME_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), pii.pii_key(spark)).select("doc_id", "text", "n_entities")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.classify_urls(table(spark, sf_dir, "pages"), url_filter.train(spark))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_query(spark, table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(PIECE_MODEL, "rb") as file:
        model = file.read()
    return pieces.round_trip(table(spark, sf_dir, "documents"), model)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.shingle_groups(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", noisy), F.col("id") % 100 == 0)


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_tiff_media": op3_tiff_media,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op12_jaccard_join": jaccard_join.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
