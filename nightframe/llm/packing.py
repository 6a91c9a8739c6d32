"""Packing documents into training sequences: best fit, with documents that must not share a sequence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.common import SPACES, whole, written


class Bins:
    """Open bins by what is left in them. A bitmap (an int, bit k for bin k) says which bins have each residual, and one
    for each source and each cluster says which bins hold it."""

    def __init__(self, capacity: int):
        self.capacity, self.left = capacity, []
        self.by_left = [0] * (capacity + 1)
        self.levels = 0  # bit r: some bin has r left
        self.holds: dict[tuple[str, object], int] = {}

    def put(self, size: int, marks: list[tuple[str, object]]) -> tuple[int, int]:
        """Places a piece into the tightest bin that holds none of ``marks``, else into a new one; (bin, offset)."""
        barred = 0
        for mark in marks:
            barred |= self.holds.get(mark, 0)
        levels, found = self.levels >> size << size, -1
        while levels:
            low = levels & -levels
            fits = self.by_left[low.bit_length() - 1] & ~barred
            if fits:
                found = (fits & -fits).bit_length() - 1
                break
            levels ^= low
        if found < 0:
            found = len(self.left)
            self.left.append(self.capacity)
        else:
            self._leave(found)
        offset = self.capacity - self.left[found]
        self.left[found] -= size
        if self.left[found]:
            self.by_left[self.left[found]] |= 1 << found
            self.levels |= 1 << self.left[found]
        for mark in marks:
            self.holds[mark] = self.holds.get(mark, 0) | 1 << found
        return found, offset

    def _leave(self, k: int) -> None:
        r = self.left[k]
        self.by_left[r] &= ~(1 << k)
        if not self.by_left[r]:
            self.levels &= ~(1 << r)


def token_counts(docs: DataFrame, text_col: str = "text"):
    """Words between white space."""
    text = F.trim(F.translate(whole(text_col), SPACES, " " * len(SPACES)))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " +"))).cast("long")


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    shard_rows: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    one_of_source: bool = True,
    cluster_col: str | None = None,
) -> DataFrame:
    """Bins of ``capacity`` tokens (words), one row per piece: ``doc_id, piece, n_tokens, shard, bin, offset``.

    A longer document is cut into pieces of ``capacity``, all but the last of which fill a bin. No bin holds two
    documents of one duplicate cluster (``cluster_col``, such as a component of near duplicates; if it isn't named, equal
    texts but for case and white space), nor, with ``one_of_source``, two of one source. Pieces go in from the longest to
    the shortest, ties by id; each goes to the tightest bin that holds neither its source nor its cluster: the search
    goes up from its own size until a bin is compatible.

    Documents are dealt to shards of about ``shard_rows`` by a hash of id and text, so neither a hot source nor a group
    of copies meets in one task; bins don't span shards. Only ids, lengths and marks are shuffled, not texts. A null or
    empty text has no token and gets one row with null ``bin``; a null source or cluster conflicts with nothing; null ids
    come last and stay null; rows that repeat an id are packed each; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    norm = F.lower(F.translate(whole(text_col), SPACES, ""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        token_counts(docs, text_col).alias("n"),
        (F.col(source_col) if source_col in docs.columns else F.lit(None)).cast("string").alias("source"),
        (F.xxhash64(norm) if cluster_col is None else F.when(F.col(cluster_col).isNotNull(), F.xxhash64(F.col(cluster_col)))).alias("cluster"),
        F.xxhash64(F.col(id_col), norm).alias("_h"),
    )
    rows = written(rows)
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 4))

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("last", "descending"), ("doc_id", "ascending"), ("_h", "ascending")])
        bins, owner, out = Bins(capacity), [], []
        columns = (table.column(c).to_pylist() for c in ("n", "last", "source", "cluster"))
        for k, (n, last, source, cluster) in enumerate(zip(*columns, strict=True)):
            full = (n - last) // capacity
            for piece in range(full):
                owner.append(k)
                out.append((piece, capacity, *bins.put(capacity, [])))
            if last:
                marks = [("cluster", cluster)] if cluster is not None else []
                marks += [("source", source)] if one_of_source and source is not None else []
                owner.append(k)
                out.append((full, last, *bins.put(last, marks)))
        piece, size, where, offset = np.array(out, np.int64).reshape(-1, 4).T
        ids = table.column("doc_id").take(pa.array(owner, pa.int64()))
        return pa.table([ids, piece, size, np.full(len(out), key[0].as_py()), where, offset], names=["doc_id", "piece", "n_tokens", "shard", "bin", "offset"])

    packed = rows.filter("n > 0").withColumn("shard", F.pmod("_h", F.lit(shards)))
    packed = packed.withColumn("last", F.when(F.col("n") % capacity == 0, F.least("n", F.lit(capacity))).otherwise(F.col("n") % capacity))
    packed = packed.repartition(tasks, "shard").groupBy("shard").applyInArrow(fill, f"doc_id {kind}, piece bigint, n_tokens bigint, shard bigint, bin bigint, offset bigint")
    none = F.lit(None).cast("long")
    empty = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), "n", none.alias("shard"), none.alias("bin"), none.alias("offset"))
    return packed.select("doc_id", "piece", "n_tokens", "shard", "bin", "offset").union(empty)


def fill_rate(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``bins, tokens, rate``: how many bins there are and what share of them is filled; the rate is null without bins."""
    sizes = packed.filter("bin is not null").groupBy("shard", "bin").agg(F.sum("n_tokens").alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("rate"))
