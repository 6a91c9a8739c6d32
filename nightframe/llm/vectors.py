"""Integer vectors made from a column of arrays, and their passage between Spark and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * c)`` of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty and without null, NaN and infinite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def of_one_length(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """The rows whose array has the length that most rows have (of lengths equally common, the longest), and that length;
    0 if there are no rows. Rows of other lengths can't be compared with these and take no part."""
    found = df.groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = found["d"] if found else 0
    return df.filter(F.size(col) == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The lists of an Arrow column, each of length ``d``, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind)
    return values.astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Integers as bytes, the width of one in front."""
    small = narrow(values)
    return bytes([small.itemsize]) + small.tobytes()


def unpack(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, columns)
