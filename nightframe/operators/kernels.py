"""Recurrences that are not set-based, in numpy, and the grouped operators that run them one series at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe import params as P
from nightframe.functions.exprs import finite

TINY = 1e-12


def change_points(values: np.ndarray, penalty: float) -> list[int]:
    """Where the best partition into segments of constant mean begins a new one. Cost: squared error, plus ``penalty`` a
    segment; of equal costs the earliest split wins. Missing values count as zero.

    A start of the last segment is dropped for good once it can't win: for every mean of the segment there has been a place
    where beginning anew cost less. The means left to a start are kept as an interval; some hundred starts are open at a
    time where all of them would be compared otherwise.
    """
    x = np.nan_to_num(np.asarray(values, float))
    n = len(x)
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    best, origin = np.zeros(n + 1), np.zeros(n + 1, int)
    best[0] = -penalty
    slack = 1e-10 * (1 + q[n])  # for rounding
    start, low, high = np.zeros(1, int), np.full(1, -np.inf), np.full(1, np.inf)
    for t in range(1, n + 1):
        size, total = t - start, s[t] - s[start]
        cost = best[start] + (q[t] - q[start] - total * total / size) + penalty
        least = int(cost.argmin())
        origin[t], best[t] = start[least], cost[least]
        left = best[t] + penalty + slack - cost
        reach = np.sqrt(np.maximum(left, 0) / size)
        low, high = np.maximum(low, total / size - reach), np.minimum(high, total / size + reach)
        kept = (left >= 0) & (low <= high + 1e-9 * (1 + np.abs(high)))
        start, low, high = start[kept], low[kept], high[kept]
        # within a run of equal values the cost of beginning is concave, so only the ends of a run need be tried
        if t == n or x[t] != x[t - 1]:
            start, low, high = np.append(start, t), np.append(low, -np.inf), np.append(high, np.inf)
    found, t = [], n
    while t > 0 and origin[t] > 0:
        t = int(origin[t])
        found.append(t)
    return found[::-1]


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray | None, int]:
    """Gauss-Jordan with partial pivoting; no solution where a pivot is under 1e-12. Also how many pivots came near."""
    m = np.column_stack([np.array(a, float), np.array(b, float)])
    near = 0
    for k in range(len(m)):
        p = k + int(np.abs(m[k:, k]).argmax())
        if abs(m[p, k]) < TINY:
            return None, near + 1
        near += abs(m[p, k]) < 1e-8
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        others = np.arange(len(m)) != k
        m[others] -= np.outer(m[others, k], m[k])
    return m[:, -1], near


def residuals(target: np.ndarray, controls: np.ndarray) -> tuple[np.ndarray, bool]:
    """What controls leave of a target, by least squares with an intercept; whether the system was unsound."""
    t = target - target.mean()
    if not controls.size:
        return t, False
    c = controls - controls.mean(0)
    beta, near = solve(c.T @ c, c.T @ t)
    if beta is None:
        return np.full(len(t), np.nan), True
    return t - c @ beta, near >= 2


def plain_correlation(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(), y - y.mean()
    scale = math.sqrt(float(x @ x) * float(y @ y))
    return float(np.clip(x @ y / scale, -1, 1)) if scale > TINY else math.nan


def partial_autocorrelation(values: np.ndarray, lags: int) -> list[tuple[int, float, bool]]:
    """For each lag, what is left of x(t) and x(t - lag) after the values between, over complete cases."""
    x = np.asarray(values, float)
    out = []
    for k in range(1, min(lags, len(x) - 1) + 1):
        rows = np.column_stack([x[k - j : len(x) - j] for j in range(k + 1)])
        rows = rows[np.isfinite(rows).all(1)]
        if len(rows) <= k + 1:
            out.append((k, math.nan, True))
            continue
        a, bad_a = residuals(rows[:, 0], rows[:, 1:k])
        b, bad_b = residuals(rows[:, k], rows[:, 1:k])
        r = plain_correlation(a, b) if np.isfinite(a).all() and np.isfinite(b).all() else math.nan
        out.append((k, r, bad_a or bad_b or math.isnan(r)))
    return out


def partial_correlation(x: np.ndarray, y: np.ndarray, controls: np.ndarray) -> float:
    """Correlation of what the controls leave; of the raw series where the controls are singular."""
    rows = np.column_stack([x, y, controls])
    rows = rows[np.isfinite(rows).all(1)]
    if len(rows) < 3:
        return math.nan
    a, _ = residuals(rows[:, 0], rows[:, 2:])
    b, _ = residuals(rows[:, 1], rows[:, 2:])
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        a, b = rows[:, 0], rows[:, 1]
    return plain_correlation(a, b)


def exact_rank_p(doubled: np.ndarray, n1: int) -> float:
    """Two-sided p of a rank sum: the share of all choices of ``n1`` ranks that are at least as far from the mean.
    ``doubled`` holds twice the average ranks of all values, the first group first."""
    n, total = len(doubled), int(doubled.sum())
    ways = [dict() for _ in range(n1 + 1)]
    ways[0][0] = 1
    for r in map(int, doubled):
        for k in range(n1, 0, -1):
            for s, c in ways[k - 1].items():
                ways[k][s + r] = ways[k].get(s + r, 0) + c
    mean, seen = round(n1 * total / n), int(doubled[:n1].sum())
    far = sum(c for s, c in ways[n1].items() if abs(s - mean) >= abs(seen - mean))
    return min(1.0, far / math.comb(n, n1))


def permuted_hits(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, seen: float, rounds: int, seed: int, plain: int = 1_000_000) -> int:
    """How many of so many random pairings of two samples have a sum of products at least as large, by size, as ``seen``.

    The samples are given by their distinct values (about their means) and how often each occurs. Up to ``plain`` rows one
    sample is shuffled; of more rows a pairing is drawn as a table with the given margins, one value of the sample with
    fewer of them after the other, so the work grows with the distinct values and not with the rows.
    """
    if len(a) > len(b):
        a, of_a, b, of_b = b, of_b, a, of_a
    rng, hits, least = np.random.default_rng(seed), 0, abs(seen) * (1 - 1e-12) - 1e-9
    if of_a.sum() <= plain:
        left, right = np.repeat(a, of_a), np.repeat(b, of_b)
        return sum(abs(float(left @ rng.permutation(right))) >= least for _ in range(rounds))
    for _ in range(rounds):
        rest, total = of_b.copy(), 0.0
        for value, n in zip(a[:-1], of_a[:-1], strict=True):
            drawn = rng.multivariate_hypergeometric(rest, n, method="marginals")
            total += value * float(drawn @ b)
            rest -= drawn
        hits += abs(total + a[-1] * float(rest @ b)) >= least
    return hits


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    floor, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > floor else floor)
            c = c if abs(c) > floor else floor
            h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return front * h


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    if not (math.isfinite(t) and df > 0):
        return math.nan if not math.isinf(t) else 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def correlation_p(rho: float, df: float) -> float:
    if not math.isfinite(rho) or df <= 0:
        return math.nan
    if abs(rho) >= 1:
        return 0.0
    return student_p(rho * math.sqrt(df / (1 - rho * rho)), df)


def best_cuts(n: np.ndarray, total: np.ndarray, squares: np.ndarray, k: int) -> tuple[list[int], float]:
    """Where the best partition of weighted points on a line into ``k`` runs begins each run but the first, and its sum of
    squares. Points have counts, sums and sums of squares; of equal partitions the one with the earliest last cut wins."""
    m, k = len(n), min(k, len(n))
    c, s, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (n, total, squares))
    size, span = c[None, :] - c[:, None], s[None, :] - s[:, None]
    later = np.triu(np.ones((m + 1, m + 1), bool), 1)
    cost = np.where(later, q[None, :] - q[:, None] - np.divide(span * span, size, out=np.zeros_like(size), where=later), np.inf)
    best, origin = np.where(np.arange(m + 1) == 0, 0.0, np.inf), []
    for _ in range(k):
        ways = best[:, None] + cost
        origin.append(ways.argmin(axis=0))
        best = ways.min(axis=0)
    cuts, at = [], m
    for back in reversed(origin):
        at = int(back[at])
        cuts.append(at)
    return cuts[::-1][1:], float(max(0.0, best[m]))


# --- grouped operators ---------------------------------------------------------------------------------------------


def _grouped(df: DataFrame, by: list[str], columns: dict, order: str | None):
    """Each series in one group, reduced to what its kernel needs."""
    slim = df.select(*by, *[c.alias(n) for n, c in columns.items()])
    key = by or [F.lit(0).alias("_one")]
    ordered = (lambda pdf: pdf.sort_values(order, kind="stable")) if order else (lambda pdf: pdf)
    return slim.groupBy(*key), ordered, [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in by]


def change_point_days(df: DataFrame, day: str, value: str, penalty: float = 10.0, by: list[str] = ()) -> DataFrame:
    by = list(by)
    groups, ordered, keys = _grouped(df, by, {"_day": F.to_date(day), "_x": finite(value)}, "_day")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        at = change_points(pdf["_x"].to_numpy(float), penalty)
        edges = [0, *at, len(pdf)]
        means = [pdf["_x"].iloc[a:b].mean() for a, b in zip(edges, edges[1:], strict=False)]
        out = pdf.iloc[at][[*by, "_day"]].rename(columns={"_day": "day"})
        return out.assign(shift=[abs(b - a) for a, b in zip(means, means[1:], strict=False)])

    return groups.applyInPandas(run, ", ".join([*keys, "day date", "shift double"]))


def partial_autocorrelations(df: DataFrame, day: str, value: str, lags: int = 30, by: list[str] = ()) -> DataFrame:
    by = list(by)
    groups, ordered, keys = _grouped(df, by, {"_day": F.col(day), "_x": finite(value)}, "_day")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = partial_autocorrelation(ordered(pdf)["_x"].to_numpy(float), lags)
        out = pd.DataFrame(found, columns=["lag", "pacf", "unstable"]).assign(**{b: pdf[b].iloc[0] for b in by})
        return out[[*by, "lag", "pacf", "unstable"]]

    out = groups.applyInPandas(run, ", ".join([*keys, "lag int, pacf double, unstable boolean"]))
    return out.withColumn("pacf", finite("pacf"))


def partial_from_covariances(c: np.ndarray, rows: float, i: int, j: int, controls: list[int]) -> float:
    """The correlation of columns ``i`` and ``j`` of what the controls leave, out of a covariance matrix over ``rows`` complete
    rows; of the raw columns where the controls are singular."""
    if rows < 3:
        return math.nan
    both = np.array([i, j])
    left = c[np.ix_(both, both)]
    if controls:
        inner, cross = c[np.ix_(controls, controls)] * (rows - 1), c[np.ix_(controls, both)] * (rows - 1)
        beta = [solve(inner, cross[:, k])[0] for k in (0, 1)]
        if beta[0] is not None and beta[1] is not None:
            left = left - np.stack(beta) @ cross / (rows - 1)
    scale = math.sqrt(max(0.0, left[0, 0]) * max(0.0, left[1, 1]))
    return float(np.clip(left[0, 1] / scale, -1, 1)) if scale * (rows - 1) > TINY else math.nan


def _moments(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``by``, ``n`` rows, ``m`` complete ones, and the upper triangle of their covariances, from one aggregation."""
    v = [finite(c) for c in columns]
    complete = F.lit(True)
    for x in v:
        complete &= x.isNotNull()
    own = [F.when(complete, x) for x in v]
    triangle = F.array(*[F.coalesce(F.covar_samp(own[i], own[j]), F.lit(0.0)) for i in range(len(v)) for j in range(i, len(v))])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(complete, 1)).alias("m"), triangle.alias("_c"))


def _covariances(triangle: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = triangle
    return out + np.triu(out, 1).T


def partial_correlations(df: DataFrame, x: str, y: str, controls: list[str], by: list[str] = ()) -> DataFrame:
    """``r`` of x and y given the controls, and ``n``, for each group. The rows are reduced to moments by Spark, so a group may
    have any number of them; the systems of the groups are solved from those."""
    by, k = list(by), 2 + len(controls)
    sums = _moments(df, [x, y, *controls], by)

    def run(frames):
        for pdf in frames:
            r = [partial_from_covariances(_covariances(np.array(c), k), m, 0, 1, list(range(2, k))) for c, m in zip(pdf["_c"], pdf["m"], strict=True)]
            yield pdf[by].assign(r=r, n=pdf["n"])

    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in by]
    return sums.mapInPandas(run, ", ".join([*keys, "r double, n bigint"])).withColumn("r", finite("r"))


def partial_matrix(df: DataFrame, columns: list[str], controls: list[str]) -> DataFrame:
    """Every ordered pair of ``columns`` with its correlation ``r`` and what is left of it, ``partial``, given those of the
    ``controls`` that are neither of the two; over the rows that have all columns, from one aggregation."""
    names = list(dict.fromkeys([*columns, *controls]))
    k = len(names)

    def run(frames):
        for pdf in frames:
            c, m = _covariances(np.array(pdf["_c"].iloc[0]), k), pdf["m"].iloc[0]
            out = []
            for i, a in enumerate(columns):
                for j, b in enumerate(columns):
                    given = [names.index(g) for g in controls if g not in (a, b)]
                    out.append((a, b, partial_from_covariances(c, m, i, j, []), 1.0 if i == j else partial_from_covariances(c, m, i, j, given)))
            yield pd.DataFrame(out, columns=["x", "y", "r", "partial"])

    out = _moments(df, names, []).mapInPandas(run, "x string, y string, r double, partial double")
    return out.withColumns({"r": finite("r"), "partial": finite("partial")})
