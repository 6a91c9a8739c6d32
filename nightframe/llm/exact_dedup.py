"""Exact deduplication by tree-merging sorted runs of digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.common import SPACES, whole, written

#: What makes two texts one: SHA-256, verified by the length and a second, independent hash of the normalised text.
KEY = ["_sha", "_len", "_xx"]


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One short row per document: id, digests of the text without white space, and the run (partition) it is in."""
    text = whole(text_col)
    norm = F.translate(text, SPACES, "")
    return docs.select(
        F.col(id_col).alias("_id"),
        F.sha2(norm.cast("binary"), 256).alias("_sha"),
        F.length(norm).alias("_len"),
        F.xxhash64(norm).alias("_xx"),
        F.length(text).alias("_points"),
        F.spark_partition_id().alias("_run"),
        F.monotonically_increasing_id().alias("_row"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """Groups of texts that are equal but for white space, and the row of each that stays.

    Every partition is one run. A run keeps one entry for each digest: the entry of the row with the longest original
    text, then the smallest id, and the number of rows. In each round ``fan_in`` runs meet in one (run numbers lose
    log2(fan_in) bits) and equal digests merge, until one run is left. The entries of a run are spread over tasks by
    digest, so no task holds the whole; each task sorts its share by run and digest and merges neighbours, which is how
    Spark aggregates entries of several fields. Digests are verified by length and a second hash, not byte by byte. The winners then go down the same tree, so that
    a digest that a third of all rows have is dealt out by run and not to one task.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256, n_points``. Null text counts as empty, so all
    empty and all-white texts are one group; a null id never wins against a known one; of rows that repeat an id
    and a text exactly one is kept; an empty table gives no rows; other columns of ``docs`` are not looked at.
    """
    base = written(text_digests(docs, id_col, text_col))
    bits = fan_in.bit_length() - 1
    best = F.min(F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id"), F.col("_row"))).alias("_best")
    level = written(base.groupBy("_run", *KEY).agg(best, F.count(F.lit(1)).alias("_n")))
    levels, left = [level], base.agg(F.max("_run")).first()[0] or 0
    while left:
        left >>= bits
        level = level.withColumn("_run", F.shiftright("_run", bits)).groupBy("_run", *KEY)
        level = written(level.agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n")))
        levels.append(level)
    top = levels.pop()
    while levels:
        up = top.withColumnRenamed("_run", "_up")
        low = levels.pop().select("_run", *KEY, F.shiftright("_run", bits).alias("_up"))
        top = low.join(up, ["_up", *KEY]).drop("_up")
    out = base.join(top, ["_run", *KEY])
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("_best")["_id"].alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        (F.col("_best")["_row"] == F.col("_row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.col("_points").cast("long").alias("n_points"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` does not keep; same columns, each text once."""
    flags = written(exact_duplicates(docs, id_col, text_col, fan_in))
    stays = flags.filter("kept").select(F.col("doc_id").alias("__nf_keep"), F.col("text_sha256").alias("__nf_keep_sha"))
    sha = F.sha2(F.translate(whole(text_col), SPACES, "").cast("binary"), 256)
    on = docs[id_col].eqNullSafe(F.col("__nf_keep")) & (sha == F.col("__nf_keep_sha"))
    kept = docs.join(stays, on, "left_semi")
    again = flags.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("k"))
    if again.filter("n > 1 and k").limit(1).count():
        # rows that repeat both id and text: one of them
        return kept.withColumn("__nf_sha", sha).dropDuplicates([id_col, "__nf_sha"]).drop("__nf_sha")
    return kept


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, pts, norm,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS n
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY pts DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept,
       sha256(norm) AS text_sha256, CAST(pts AS BIGINT) AS n_points
FROM g
"""
