"""Whitening and hard negatives against numpy over the same integer vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframe.llm import negatives, vectors, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n string, score string, i string, band string"


def table(spark, n, d, seed=1, odd=True):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.6) for _ in range(d)] for _ in range(5)]
    rows = []
    for k in range(n):
        c = rnd.choice(centres)
        rows.append((k, [v + rnd.gauss(0, 0.2) for v in c], rnd.randrange(10)))
    if odd:
        rows += [(rows[0][0] + n, rows[0][1], 3)] * 2 + [(n + 7, None, 1), (n + 8, [None] * d, 1), (n + 9, [float("nan")] * d, 1), (n + 10, [float("inf")] + [0.0] * (d - 1), 1)]
        rows += [(n + 11, [], 2), (n + 12, [1.0], 2), (None, rows[3][1], 4), (n + 13, rows[4][1], None), (n + 14, [-0.0] * d, 5)]
    return spark.createDataFrame([(*r, *["z"] * 5) for r in rows], SCHEMA)


def integers(df, d):
    rows = [r for r in df.collect() if r["embedding"] and len(r["embedding"]) == d and all(v is not None and np.isfinite(v) for v in r["embedding"])]
    return rows, np.array([np.floor(256 * np.asarray(r["embedding"], np.float64)).astype(np.int64) for r in rows])


@pytest.mark.parametrize("d,tile,block", [(7, 3, 16), (40, None, 4096), (33, 8, 50)])
def test_whitening(spark, d, tile, block):
    df = table(spark, 300, d)
    rows, x = integers(df, d)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    got = whitening.whiten(df, tile=tile, row_block=block).collect()
    assert len(got) == 4 * len(x)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for k in range(4):
        e, v = values[-1 - k], basis[:, -1 - k]
        want = (x - sums / n) @ v / np.sqrt(e)
        mine = [by[r["vec_id"], k + 1][0] for r in rows]
        sign = np.sign(want[0] * mine[0]["whitened"])
        assert np.allclose([m["whitened"] for m in mine], sign * want, atol=1e-9)
        assert [m["deviation"] for m in mine] == ((n * x - sums) ** 2).sum(axis=1).tolist()
        assert mine[0]["explained"] == pytest.approx(e / values.sum(), rel=1e-9) and mine[0]["n"] == n
    assert 0 <= got[0]["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    df = table(spark, 50, 6)
    assert whitening.whiten(df.filter("false")).count() == 0
    assert whitening.whiten(df.filter("vec_id = 1")).count() == 0  # no variance
    two = whitening.whiten(df.filter("vec_id in (1, 2)")).collect()
    assert {r["component"] for r in two} == {1} and sorted(round(r["whitened"], 9) for r in two) == [-1, 1]
    huge = spark.createDataFrame([(1, [3e30, 1.0]), (2, [-3e30, 2.0]), (3, [5.0, 7.0])], "vec_id bigint, embedding array<double>")
    # entries that don't fit into 64 bits are the largest and smallest that do
    assert {r["deviation"] for r in whitening.whiten(huge).collect()} == {None, 2561**2 + 2816**2}


def test_exact_sums(spark):
    x = np.array([[2**40, -3], [5, 2**41]], np.int64)
    sums, n = [2**50 + 1, -7], 2**30
    assert whitening.deviations(x, n, sums) == [v if (v := sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True))) < 2**63 else None for row in x]
    assert vectors.unpack(vectors.pack(x), 2).tolist() == x.tolist()


def brute(rows, x, anchors, positives=5, wanted=10, least=30, most=90):
    seen = {}
    for r, v in zip(rows, x, strict=True):
        if r["vec_id"] is not None and r["label"] is not None:
            key = (r["label"], v.tolist())
            seen[r["vec_id"]] = min(seen.get(r["vec_id"], key), key)
    out = set()
    for a in filter(anchors, seen):
        score = {i: int(np.dot(seen[a][1], v)) for i, (_, v) in seen.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if seen[i][0] == seen[a][0]][:positives]:
            fit = [i for i in order if seen[i][0] != seen[a][0] and least * score[p] <= 100 * score[i] <= most * score[p]]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:wanted])}
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("d,block,pivots", [(6, 32, 3), (24, 2048, 8)])
def test_hard_negatives(spark, d, block, pivots):
    df = table(spark, 400, d)
    rows, x = integers(df, d)
    got = negatives.hard_negatives(df, F.col("id") % 10 == 0, block=block, pivots=pivots)
    assert got.columns == COLUMNS
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, x, lambda i: i % 10 == 0)


def test_hard_negatives_with_ties_and_few_rows(spark):
    """Equal vectors everywhere, negative scores, labels with fewer rows than wanted, and one hot vector."""
    rnd = random.Random(2)
    kinds = [[rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] for _ in range(6)]
    rows = [(k, kinds[0] if k % 3 == 0 else rnd.choice(kinds), rnd.choice([0, 0, 0, 1, k % 7])) for k in range(250)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    own, x = integers(df, 4)
    got = [tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 7 == 0, block=16, pivots=3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(own, x, lambda i: i % 7 == 0)
    assert negatives.hard_negatives(df.filter("false"), F.col("id") == 0).count() == 0
    assert negatives.hard_negatives(df.filter("vec_id < 2"), F.col("id") == 0).collect() == []


def test_brackets_hold(spark):
    rnd = np.random.default_rng(3)
    x = rnd.integers(-300, 300, (200, 12))
    x[:40] = x[0]
    pivots = negatives.Pivots(x[:50], float((x * x).sum(axis=1).max()), 5)
    far = pivots.of_rows(x)
    lower, upper = pivots.bracket(x[:9], pivots.of_anchors(x[:9]), far, far)
    score = x[:9] @ x.T
    assert (lower <= score).all() and (score <= upper).all() and (upper - lower < 2 * pivots.longest).any()
