"""Hard negatives by a pivot table.

The largest inner product is the smallest distance once every row ``x`` has one more coordinate that makes all rows equally
long: with ``M`` the largest length and 0 as the anchor's further coordinate, ``d(q, x)^2 = |q|^2 + M^2 - 2 q.x``. The table
holds each row's distances from a few pivots. By the triangle inequality ``d(q, x)`` lies between ``max |d(q, p) - d(x, p)|``
and ``min d(q, p) + d(x, p)``, which brackets the score; rows whose bracket can't matter any more are passed over and the
scores of the others are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.llm.common import written
from nightframe.llm.vectors import integers, matrix, of_one_length, pack, unpack, usable

#: Squared lengths stay under this, so a hundred times a score fits into 64 bits.
LONGEST = 2**55


class Pivots:
    """Pivots among the augmented rows and the distances from them."""

    def __init__(self, sample: np.ndarray, longest: float, most: int):
        self.longest = longest
        rows = self.augmented(sample)
        chosen, nearest = [0], np.full(len(rows), np.inf)
        while len(chosen) < most:
            nearest = np.minimum(nearest, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
            if nearest.max() <= 1e-9 * longest:
                break
            chosen.append(int(nearest.argmax()))
        self.points = rows[chosen]
        #: what rounding can add to a score's bracket
        self.slack = 1.0 + 4e-6 * longest

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))])

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows from the pivots."""
        return np.sqrt(np.maximum(2 * self.longest - 2 * self.augmented(x) @ self.points.T, 0))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        """Distances of anchors, whose further coordinate is 0."""
        x = x.astype(np.float64)
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + self.longest - 2 * x @ self.points[:, :-1].T, 0))

    def scores(self, squares: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of scores where distances lie between ``least`` and ``most``."""
        both = squares + self.longest
        return (both - most * most) / 2 - self.slack, (both - least * least) / 2 + self.slack

    def bracket(self, x: np.ndarray, anchors: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of anchors with rows whose distances from the pivots lie between ``near`` and ``far``
        (the same array for single rows)."""
        least, most = np.zeros((len(x), len(near))), np.full((len(x), len(near)), np.inf)
        for j in range(len(self.points)):
            own = anchors[:, j, None]
            np.maximum(least, own - far[None, :, j], out=least)
            np.maximum(least, near[None, :, j] - own, out=least)
            np.minimum(most, own + far[None, :, j], out=most)
        return self.scores((x.astype(np.float64) ** 2).sum(axis=1)[:, None], least, most)


def products(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Exact inner products of integer vectors with squared lengths up to ``longest``."""
    if longest < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The first ``k`` rows of every query: larger scores first, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.query, self.score, self.id = k, *(np.zeros(0, np.int64),) * 3
        self.bar = np.full(queries, -np.inf)  # what a score has to reach

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        begin = np.concatenate([[True], q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(begin, np.arange(len(q)), 0))
        kept = rank < self.k
        self.query, self.score, self.id = q[kept], s[kept], i[kept]
        last = rank == self.k - 1
        self.bar[q[last]] = s[last]


def packed_rows(rows: DataFrame, pivots: Pivots, d: int, n: int, block: int, groups: int) -> DataFrame:
    """The pivot table: blocks of up to ``block`` rows that lie near each other, dealt over ``groups`` groups."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = pivots.of_rows(matrix(batch.column(2), d)) if batch.num_rows else np.zeros((0, 1))
            made = [pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["id", "label", "x", "cell", "apart"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() % groups
        for batch in batches:
            for begin in range(0, batch.num_rows, block):
                own = batch.slice(begin, block)
                ids, labels = (own.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                x = matrix(own.column(2), d)
                made = [pa.array([v], pa.binary()) for v in (ids.tobytes(), labels.tobytes(), pack(x), pivots.of_rows(x).tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), *made], names=["g", "ids", "labels", "xs", "far"])

    placed = rows.mapInArrow(place, "id bigint, label bigint, x array<bigint>, cell int, apart double")
    near = placed.repartitionByRange(groups, "cell", "apart", "id").sortWithinPartitions("cell", "apart", "id")
    return written(near.select("id", "label", "x").mapInArrow(cut, "g int, ids binary, labels binary, xs binary, far binary"), "pivots")


def search(queries: DataFrame, index: DataFrame, pivots: Pivots, d: int, k: int, same: bool, block: int = 256) -> DataFrame:
    """``anchor_id, band, id, score``: for every query and band the first ``k`` rows with the anchor's label (``same``) or
    another one, whose hundredfold score lies in the band.

    ``queries`` has ``id, label, x`` and ``bands``, an array of ``low, high``. Blocks of queries meet every block of rows;
    each task hands on its first ``k``, and the first of those are taken.
    """
    groups = index.agg(F.max("g")).first()[0] + 1
    tasks = max(1, -(-queries.count() // (4 * block)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, block):
                own = batch.slice(begin, block)
                ids, labels = (own.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                made = [ids.tobytes(), labels.tobytes(), pack(matrix(own.column(2), d))]
                bands = own.column(3).to_pylist()
                width = max(map(len, bands))
                ends = np.array([[(b["low"], b["high"]) for b in x] + [(1, 0)] * (width - len(x)) for x in bands], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (*made, ends.tobytes())], names=["qids", "qlabels", "qxs", "bands"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None

        def hand_on() -> pa.RecordBatch:
            anchor, band = np.divmod(best.query, bands.shape[1])
            return pa.RecordBatch.from_arrays([pa.array(qids[anchor]), pa.array(band.astype(np.int32)), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "band", "id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                qid, qlabel, qx, ends, rid, rlabel, rx, far = (batch.column(c)[row].as_py() for c in range(8))
                if qid != now:
                    if best is not None:
                        yield hand_on()
                    qids, qlabels, q = np.frombuffer(qid, np.int64), np.frombuffer(qlabel, np.int64), unpack(qx, d)
                    bands = np.frombuffer(ends, np.int64).reshape(len(qids), -1, 2)
                    now, best, own = qid, Best(bands.shape[0] * bands.shape[1], k), pivots.of_anchors(q)
                    best.bar[(bands[..., 0] > bands[..., 1]).ravel()] = np.inf  # nothing lies in an empty band
                ids, labels, x = np.frombuffer(rid, np.int64), np.frombuffer(rlabel, np.int64), unpack(rx, d)
                apart = np.frombuffer(far).reshape(len(ids), -1)
                _, upper = pivots.bracket(q, own, apart.min(axis=0)[None], apart.max(axis=0)[None])
                # bars of bands that are full; a block none of whose rows can reach the lowest of them is passed over
                open_ = np.flatnonzero(upper[:, 0] >= best.bar.reshape(bands.shape[:2]).min(axis=1))
                if not len(open_):
                    continue
                lower, upper = pivots.bracket(q[open_], own[open_], apart, apart)
                fit = (qlabels[open_][:, None] == labels) if same else (qlabels[open_][:, None] != labels)
                fit &= qids[open_][:, None] != ids
                masks = []
                for b in range(bands.shape[1]):
                    low, high = (bands[open_, b, e, None] / 100 for e in (0, 1))
                    bar = best.bar[open_ * bands.shape[1] + b][:, None]
                    masks.append(fit & (low <= high) & (upper >= low) & (lower <= high) & (upper >= bar))
                wanted = np.any(masks, axis=0)
                some, those = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
                if not len(some):
                    continue
                score = products(q[open_[some]], x[those], pivots.longest)
                for b, mask in enumerate(masks):
                    low, high = (bands[open_[some], b, e, None] for e in (0, 1))
                    at = open_[some] * bands.shape[1] + b
                    anchor, place = np.nonzero(mask[np.ix_(some, those)] & (100 * score >= low) & (100 * score <= high) & (score >= best.bar[at][:, None]))
                    best.add(at[anchor], score[anchor, place], ids[those[place]])
        if best is not None:
            yield hand_on()

    blocks = queries.select("id", "label", "x", "bands").repartition(tasks).mapInArrow(cut, "qids binary, qlabels binary, qxs binary, bands binary")
    sent = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "g")
    pairs = sent.hint("merge").join(index.repartition(groups, "g"), "g").select("qids", "qlabels", "qxs", "bands", "ids", "labels", "xs", "far")
    found = pairs.mapInArrow(meet, "anchor_id bigint, band int, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), F.asc("id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: int = 256,
    pivots: int = 8,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block: int = 2048,
    sample: int = 2000,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Entries become ``floor(scale * c)`` and a score is the inner product with the anchor, larger ones first, then smaller
    ids. ``anchors`` is a condition on ``id``. An anchor's positives are the first ``positives`` other rows of its label; for
    each the first ``negatives`` rows of other labels whose score lies between ``least`` and ``most`` per cent of the
    positive's are returned (fewer if there aren't so many; none if the positive's score is negative).

    Ids and labels are integers. Rows without id, label or vector, and those with null, NaN or infinite entries, take no
    part, nor do vectors of another length than most have or of a squared length of 2^55 or more, whose scores might not
    fit into 64 bits. Of rows that repeat an id the one of the smallest label and vector counts. An empty table gives no
    rows; other columns are not looked at. The pivots are chosen among ``sample`` rows, each the farthest from those before.
    """
    kept = rows.filter(usable(F.col(vector_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    kept = kept.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), integers(F.col(vector_col), scale).alias("x"))
    squares = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    kept, d = of_one_length(kept.filter(squares < float(LONGEST)), "x")
    table = written(kept.groupBy("id").agg(F.min(F.struct("label", "x")).alias("row")).select("id", "row.label", "row.x"), "vectors")
    n, longest = table.agg(F.count(F.lit(1)), F.max(squares)).first()
    if not n:
        empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return rows.sparkSession.createDataFrame([], empty)
    some = table.orderBy(F.xxhash64("id"), "id").select("x").limit(sample).collect()
    plan = Pivots(np.array([r["x"] for r in some], np.int64).reshape(-1, d), longest, pivots)
    groups = max(24, -(-n // (128 * block)))
    index = packed_rows(table, plan, d, n, block, groups)
    asked = written(table.filter(anchors), "anchors")
    everything = F.array(F.struct(F.lit(-(2**63)).alias("low"), F.lit(2**63 - 1).alias("high")))
    first = search(asked.withColumn("bands", everything), index, plan, d, positives, True)
    found = written(first.select("anchor_id", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    band = F.struct("band", (least * F.col("positive_score")).alias("low"), (most * F.col("positive_score")).alias("high"))
    bands = found.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(band)).alias("bands"))
    second = search(asked.join(bands, "id"), index, plan, d, negatives, False)
    out = second.join(found, ["anchor_id", "band"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: Squared lengths and inner products of whole numbers are exact in doubles here.
OP13_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) <= 10
"""
