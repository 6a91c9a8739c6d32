"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; ``root`` is the smallest node that can be reached.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its larger neighbours, then
    to its smaller ones. Only minima and joins on them are formed, never the list of a node's neighbours, and each
    round is checkpointed. Loops and repeated edges don't matter; no edges give no rows.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    pairs, before = checkpointed(edges.filter("a <> b").select(high, low).distinct()), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        across = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpointed(across.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
