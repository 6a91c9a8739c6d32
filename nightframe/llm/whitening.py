"""Whitening of embeddings by a tiled covariance.

The dimensions are cut into column blocks and the rows into row blocks. A tile is a pair of column blocks; for each row
block its two column blocks are sent to where the pair is multiplied, and the products are summed by tile. What meets in
one place is bounded by a row block and a tile, whatever the number of rows; the assembled matrix has one number for each
pair of dimensions, and only that comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.common import written
from nightframe.llm.vectors import integers, matrix, of_one_length, pack, unpack, usable


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: 64-bit integers where these suffice, else integers of any size."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) if x.size else 0
    if most < 2**63:
        return x.astype(np.int64) * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x`` less the mean, rounded once."""
    return (differences(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of squares of ``n * x - sums`` by row; null where one doesn't fit into 64 bits."""
    apart = differences(x, n, sums)
    most = max(abs(int(apart.min())), abs(int(apart.max()))) if apart.size else 0
    if most * most * max(1, x.shape[1]) >= 2**63:
        apart = apart.astype(object)
    return [int(v) if v < 2**63 else None for v in (apart * apart).sum(axis=1).tolist()]


def dimension_sums(fit: DataFrame, d: int) -> list[int]:
    """The exact sum of each dimension: each task adds up what it reads, Spark adds up the tasks' sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for batch in batches:
            x = matrix(batch.column(0), d)
            wide = x.size and max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= 2**63
            total = total + (x.astype(object) if wide else x).sum(axis=0)
        made = pa.array([str(int(v)) for v in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), made], names=["p", "s"])

    parts = fit.select("x").mapInArrow(add, "p int, s string")
    rows = parts.groupBy("p").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows, key=lambda r: r["p"])]


def tiled_covariance(fit: DataFrame, n: int, sums: list[int], tile: int | None = None, row_block: int = 4096) -> np.ndarray:
    """Covariance (divisor ``n``) of the vectors ``x`` of ``fit``, centred before they are multiplied.

    ``tile`` dimensions form a column block; left out, a quarter of them, 32 at least, so that a column block goes to four
    tiles at most. A row block has ``row_block`` rows at most.
    """
    d = len(sums)
    width = tile or max(32, -(-d // 4))
    cuts = [slice(k, min(d, k + width)) for k in range(0, d, width)]
    pairs = [(i, j) for i in range(len(cuts)) for j in range(i, len(cuts))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            x = matrix(batch.column(0), d)
            for begin in range(0, len(x), row_block):
                packed = [pack(x[begin : begin + row_block, c]) for c in cuts]
                rows = [(i, j, side, packed[c]) for i, j in pairs for side, c in enumerate((i, j) if i < j else (i,))]
                i, j, side, data = zip(*rows, strict=True)
                names = ["i", "j", "row_block", "side", "data"]
                made = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([task + k] * len(rows), pa.int64()), pa.array(side, pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=names)
                k += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        left = None
        for batch in batches:
            for i, j, side, data in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                own = cuts[j if side else i]
                half = centred(unpack(data, own.stop - own.start), n, sums[own])
                if i < j and not side:
                    left = half
                    continue
                product = (half if i == j else left).T @ half
                total[i, j] = total[i, j] + product if (i, j) in total else product
        for (i, j), value in total.items():
            p, q = np.meshgrid(np.arange(d)[cuts[i]], np.arange(d)[cuts[j]], indexing="ij")
            yield pa.RecordBatch.from_arrays([pa.array(p.ravel().astype(np.int32)), pa.array(q.ravel().astype(np.int32)), pa.array(value.ravel())], names=["p", "q", "v"])

    tasks = max(int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(pairs) // (64 * row_block))
    dealt = fit.select("x").mapInArrow(deal, "i int, j int, row_block bigint, side int, data binary")
    met = dealt.repartition(tasks, "i", "j", "row_block").sortWithinPartitions("i", "j", "row_block", "side")
    cells = met.mapInArrow(multiply, "p int, q int, v double").groupBy("p", "q").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((d, d))
    p, q, v = (cells.column(c).to_numpy() for c in ("p", "q", "v"))
    out[p, q] = v / n
    out[q, p] = v / n
    return out


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; the entry of largest size is positive.
    Directions without variance (to within rounding) have no whitened form and are left out."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = values > len(values) * np.finfo(np.float64).eps * max(values[0], 0)
    values, vectors = values[kept][:most], vectors[:, kept][:, :most]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[largest, np.arange(len(values))])


def identity_error(fit: DataFrame, n: int, sums: list[int], scaled: np.ndarray) -> float:
    """The largest entry, by size, of the covariance of the whitened fit list less the identity."""
    d, k = scaled.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = centred(matrix(batch.column(0), d), n, sums) @ scaled
            w = np.column_stack([w, np.ones(len(w))])
            total += w.T @ w
        at = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["p", "v"])

    rows = fit.select("x").mapInArrow(add, "p int, v double").groupBy("p").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1) * (k + 1))
    for r in rows:
        total[r["p"]] = r["v"]
    total = total.reshape(k + 1, k + 1) / n
    return float(np.abs(total[:k, :k] - np.outer(total[:k, k], total[:k, k]) - np.eye(k)).max())


def whiten(
    rows: DataFrame,
    most: int = 4,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tile: int | None = None,
    row_block: int = 4096,
) -> DataFrame:
    """Whitened coordinates of every vector along the ``most`` directions of largest variance.

    Entries become ``floor(scale * c)``; mean and covariance are those of the distinct vectors. One row for each vector and
    component: ``vec_id, component`` (from 1), ``n`` (distinct vectors), ``deviation`` (exact sum over dimensions of
    ``(n * x - sum)^2``; null if over 64 bits), ``whitened, explained`` (share of the trace), ``eigenvalue`` and
    ``identity_error``. Null and empty vectors and vectors with null, NaN or infinite entries are left out, as are vectors of
    another length than most have. Rows that repeat are each returned, null ids too; components without variance (all
    vectors equal, fewer vectors than components) are not. An empty table gives no rows; other columns are not looked at.
    Up to a few thousand dimensions: the matrix of dimension pairs is decomposed on the driver.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    kept = rows.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), integers(F.col(vector_col), scale).alias("x"))
    kept, d = of_one_length(kept, "x")
    fit = written(kept.select("x").distinct(), "fit")
    n = fit.count()
    sums = dimension_sums(fit, d) if n else []
    covariance = tiled_covariance(fit, n, sums, tile, row_block) if n else np.zeros((0, 0))
    values, vectors = components(covariance, most) if n else (np.zeros(0), np.zeros((0, 0)))
    scaled = vectors / np.sqrt(values)
    trace, k = float(np.trace(covariance)), len(values)
    error = identity_error(fit, n, sums, scaled) if k else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x = matrix(batch.column(1), d)
            own, count = np.repeat(np.arange(len(x)), k), len(x) * k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(own)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(count, n)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(own)),
                    pa.array((centred(x, n, sums) @ scaled).ravel()),
                    pa.array(np.tile(values / trace, len(x))),
                    pa.array(np.tile(values, len(x))),
                    pa.array(np.full(count, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "eigenvalue", "identity_error"],
            )

    return kept.mapInArrow(project, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, eigenvalue double, identity_error double")
