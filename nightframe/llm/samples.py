"""Bounded samples of labelled rows for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframe.llm.common import whole


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    learn: Column,
    per_class: int = 1500,
    max_chars: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[tuple[str, int]], float]:
    """Texts and labels of at most ``per_class`` documents of each class, and the share of label 1 over all labels.

    ``learn`` says which ids may be learnt from. Of those, the ids with the smallest hash are taken, so the sample does
    not depend on the order of rows. Texts of more than ``max_chars`` characters are passed over: the bound on what
    comes to the driver is ``2 * per_class * max_chars`` characters.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & learn)
    share = known.agg(F.avg("_y")).first()[0]
    if share is None:
        return [], 0.5
    order = [F.xxhash64("_id", F.lit("sample")), F.col("_id")]
    picked = known.filter("_y = 0").orderBy(*order).limit(per_class).unionByName(known.filter("_y = 1").orderBy(*order).limit(per_class))
    text = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).filter(F.length("_text") <= max_chars)
    # of rows that repeat an id one counts, so the bound holds whatever the table
    rows = text.join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).collect()
    # nor do copies of a text count twice
    return sorted({(r["_text"], r["_y"]) for r in rows}), float(share)
