"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"

#: A frame of at most so many short rows may be broadcast; the callers count first.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a new temporary one in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


#: Paths that ``written`` has made and ``temporary`` has not deleted yet.
_made: list[str] = []


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts lineage, survives lost executors.

    The table stays there, as results may be read from it, unless it is made within ``temporary``.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, the tables that operators have written within it. What is to be kept of their
    results has to be written inside the block, under a path of its own."""
    begun = len(_made)
    try:
        yield
    finally:
        for path in _made[begun:]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        del _made[begun:]


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint, for the small frames of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is. ``df`` has to be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``key``. Rows of ``left`` with one key go to as many as
    ``salts`` tasks, dealt by ``spread``, as one key may have a third of all rows."""
    dealt = left.withColumn("__nf_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("__nf_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "__nf_salt"]).drop("__nf_salt")


def portions(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a column, so that what is held for one doesn't grow with the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, ends = 0, np.cumsum(sizes, dtype=np.int64)
    while begin < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most)) + 1
        yield batch.slice(begin, stop - begin)
        begin = stop


def whole(text: str | Column) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0).cast("long"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
