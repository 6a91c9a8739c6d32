"""Kernels against slow forms and hand-computed values."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest

from nightframe.operators import kernels as K


def test_change_points_find_the_step():
    assert K.change_points(np.array([1.0] * 30 + [5.0] * 30), 8.0) == [30]
    assert K.change_points(np.array([]), 8.0) == []
    assert K.change_points(np.array([2.0] * 20), 8.0) == []


def test_change_points_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, penalty = rng.normal(size=9) + (rng.random() < 0.5) * np.repeat([0, 4, 0], 3), 2.0

        def cost(cuts):
            edges = [0, *cuts, len(x)]
            return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + penalty for a, b in zip(edges, edges[1:], strict=False))

        best = min(cost(c) for k in range(9) for c in itertools.combinations(range(1, 9), k))
        assert cost(K.change_points(x, penalty)) == pytest.approx(best)


def test_partial_autocorrelation_is_a_partial_correlation():
    x = np.array([0.8, 0.46, 0.11, 0.23, -0.05, 0.02, 0.1, 0.04])
    for k, r, _ in K.partial_autocorrelation(x, 3):
        between = np.column_stack([x[k - j : len(x) - j] for j in range(1, k)]) if k > 1 else np.zeros((len(x) - k, 0))
        assert r == pytest.approx(K.partial_correlation(x[k:], x[: len(x) - k], between), abs=1e-6)


def test_partial_autocorrelation_of_a_constant_is_unstable():
    found = K.partial_autocorrelation(np.ones(120), 80)
    assert all(math.isnan(r) and unstable for _, r, unstable in found)


def test_exact_rank_test():
    assert K.exact_rank_p(np.array([2, 4, 6, 8]), 2) == pytest.approx(2 / 6)
    ranks, n1 = np.array([2, 5, 5, 8, 10, 12, 14]), 3
    mean = n1 * ranks.sum() / 7
    ways = [abs(sum(c) - mean) >= abs(ranks[:3].sum() - mean) - 1e-9 for c in itertools.combinations(ranks, 3)]
    assert K.exact_rank_p(ranks, n1) == pytest.approx(sum(ways) / len(ways))


def test_student_p():
    assert K.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert K.student_p(0.0, 5) == pytest.approx(1.0)
    assert K.correlation_p(1.0, 5) == 0.0
    assert math.isnan(K.correlation_p(0.5, 0))


def test_solver_refuses_singular_systems():
    assert K.solve(np.ones((2, 2)), np.ones(2))[0] is None
    got, _ = K.solve(np.array([[2.0, 1.0], [1.0, 3.0]]), np.array([3.0, 5.0]))
    assert got == pytest.approx([0.8, 1.4])


def plain_permutation_p(x, y, rounds, seed):
    """One sample is shuffled for each round."""
    a, b = (pd.Series(v).rank().to_numpy() for v in (x, y))
    a, b = a - a.mean(), b - b.mean()
    seen, rng = abs(float(a @ b)), np.random.default_rng(seed)
    return (1 + sum(abs(float(a @ rng.permutation(b))) >= seen - 1e-9 for _ in range(rounds))) / (rounds + 1)


def margins(x):
    values, counts = np.unique(pd.Series(x).rank().to_numpy(), return_counts=True)
    return values - (len(x) + 1) / 2, counts


@pytest.mark.parametrize("plain", [0, 1_000_000])
def test_permutations_from_margins(plain):
    """Within three standard errors of shuffling, by shuffling and by tables with given margins."""
    rng = np.random.default_rng(5)
    for ties in (3, 8, 40):
        x = rng.integers(0, ties, 60).astype(float)
        y = x * 0.15 * rng.random() + rng.integers(0, 5, 60)
        (a, ta), (b, tb) = margins(x), margins(y)
        ra, rb = (pd.Series(v).rank().to_numpy() for v in (x, y))
        seen = float((ra - ra.mean()) @ (rb - rb.mean()))
        p = (1 + K.permuted_hits(a, ta, b, tb, seen, 1000, 1, plain)) / 1001
        want = plain_permutation_p(x, y, 4000, 2)
        assert abs(p - want) < 3 * math.sqrt(want * (1 - want) * (1 / 1000 + 1 / 4000)) + 0.002
    x = np.arange(12.0)
    assert K.permuted_hits(*margins(x), *margins(x), float(((x - x.mean()) ** 2).sum()), 200, 1) == 0


def plain_change_points(x, penalty):
    """Every place is compared with every place before it."""
    n = len(x)
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    best, origin = np.zeros(n + 1), np.zeros(n + 1, int)
    best[0] = -penalty
    for t in range(1, n + 1):
        cost = best[:t] + (q[t] - q[:t] - (s[t] - s[:t]) ** 2 / (t - np.arange(t))) + penalty
        origin[t] = int(cost.argmin())
        best[t] = cost[origin[t]]
    found, t = [], n
    while t > 0 and origin[t] > 0:
        t = int(origin[t])
        found.append(t)
    return found[::-1]


def test_dropped_starts_never_win():
    rng = np.random.default_rng(8)
    for k in range(1000):
        n = int(rng.integers(0, 90))
        levels = np.repeat(rng.normal(0, rng.choice([0.5, 3]), n // 7 + 1), 7)[:n]
        x = levels + rng.normal(0, 1, n)
        if k % 3 == 0:
            x = np.round(x * 2)  # ties and runs of equal values
        penalty = float(rng.choice([0.5, 2, 10]))
        assert K.change_points(x, penalty) == plain_change_points(x, penalty), (k, n, penalty)


def test_long_series_of_change_points():
    rng = np.random.default_rng(2)
    for x in (rng.normal(5, 1, 20_000), np.ones(100_000), np.repeat(rng.normal(0, 3, 200), 250) + rng.normal(0, 1, 50_000)):
        begun = time.time()
        K.change_points(x, 10.0)
        assert time.time() - begun < 20


def test_best_cuts():
    n, s, q = np.ones(6), np.array([0.0, 1, 2, 100, 101, 102]), np.array([0.0, 1, 4, 10_000, 10_201, 10_404])
    assert K.best_cuts(n, s, q, 2) == ([3], 4.0)
    assert K.best_cuts(n[:1], s[:1], q[:1], 3) == ([], 0.0)
