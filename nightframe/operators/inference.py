"""Correlation, rank tests, smoothing, and control of false discoveries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from nightframe import params as P
from nightframe.functions.exprs import clamp, finite, normal_cdf, ratio, wilson
from nightframe.operators import kernels, scans
from nightframe.operators.series import rank_table


@F.pandas_udf(DoubleType())
def correlation_p(rho: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by Student's t. For result rows, of which there are few."""
    return pd.Series([kernels.correlation_p(float(r), float(d)) if pd.notna(r) and pd.notna(d) else None for r, d in zip(rho, df, strict=True)], dtype="float64")


def _paired(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return df.select(*by, finite(x).alias("_x"), finite(y).alias("_y")).filter("_x is not null and _y is not null")


def pearson(df: DataFrame, x: str, y: str, by: list[str] = (), least: int = 3) -> DataFrame:
    """``r`` and ``n`` over the pairs that have both; NULL under ``least`` pairs or where a side is constant."""
    x_, y_ = F.col("_x"), F.col("_y")
    sums = _paired(df, x, y, list(by)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_samp(x_, y_).alias("_c"), F.stddev_samp(x_).alias("_sx"), F.stddev_samp(y_).alias("_sy"), F.max(F.abs(x_)).alias("_mx"), F.max(F.abs(y_)).alias("_my"))
    varies = (F.col("_sx") > 1e-12 * F.col("_mx")) & (F.col("_sy") > 1e-12 * F.col("_my"))
    r = F.when(varies & (F.col("n") >= least), ratio(F.col("_c"), F.col("_sx") * F.col("_sy")))
    return sums.select(*by, clamp(r, -1.0, 1.0).alias("r"), "n")


def _ranked(pairs: DataFrame, by: list[str], spread: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``_x, _y`` with their ranks ``_rx, _ry``, and the table of ranks of either side."""
    sides = [rank_table(pairs, c, by, f"_r{c[1:]}", spread) for c in ("_x", "_y")]
    for c, side in zip(("_x", "_y"), sides, strict=True):
        pairs = scans.matched(pairs, side.drop("_t").withColumnRenamed("_v", c), [*by, c])
    return pairs, *sides


def spearman(df: DataFrame, x: str, y: str, by: list[str] = (), least: int = 3, spread: bool = True) -> DataFrame:
    """Correlation of average ranks; ``spread=False`` where groups are known to be small."""
    by = list(by)
    return pearson(_ranked(_paired(df, x, y, by), by, spread)[0], "_rx", "_ry", by, least)


def spearman_p(df: DataFrame, x: str, y: str, by: list[str] = (), least: int = 3) -> DataFrame:
    return spearman(df, x, y, by, least).withColumn("p", correlation_p("r", (F.col("n") - 2).cast("double")))


def ols(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Slope, intercept and correlation of y on x."""
    by = list(by)
    lines = _paired(df, x, y, by).groupBy(*by).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"))
    r = pearson(df, x, y, by, 2)
    return lines.join(r, by) if by else lines.join(F.broadcast(r))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every ordered pair of columns with its correlation, from one aggregation over the rows."""
    v = {c: finite(c) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def sums(a: str, b: str) -> Column:
        both = v[a].isNotNull() & v[b].isNotNull()
        x, y = F.when(both, v[a]), F.when(both, v[b])
        s = F.when(F.stddev_samp(x) * F.stddev_samp(y) > 0, F.stddev_samp(x) * F.stddev_samp(y))
        return F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), ratio(F.covar_samp(x, y), s).alias("r"), F.count(x).alias("n"))

    long = df.agg(*[sums(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    out = long.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")
    other = out.filter("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "r", "n")
    return out.unionByName(other)


def mann_whitney(df: DataFrame, value: str, first: Column, by: list[str] = (), spread: bool = True) -> DataFrame:
    """Rank test of the rows where ``first`` is true against those where it is false.

    Ranks, ties and U come from counts by value. Up to 28 values the p is exact, by a small kernel that sees only those
    groups; beyond, normal without a continuity correction. The effect is 2 U2 / (n1 n2) - 1, its limits Wilson's. Ranks
    are running sums over slices of the values, unless groups are known to be small (``spread=False``).
    """
    by = list(by)
    x = df.select(*by, finite(value).alias("_v"), first.cast("boolean").alias("_g")).filter("_v is not null and _g is not null")
    counts = x.groupBy(*by, "_v").agg(F.count(F.when(F.col("_g"), 1)).alias("_a"), F.count(F.when(~F.col("_g"), 1)).alias("_b"))
    t = F.col("_a") + F.col("_b")
    if spread:
        placed = scans.running(scans.sliced(counts, "_v"), ["_v"], {"_upto": t}, by=by)
    else:
        placed = counts.withColumn("_upto", F.sum(t).over(W.partitionBy(*by).orderBy("_v")))
    placed = placed.withColumn("_t", t.cast("double")).withColumn("_rank", F.col("_upto") - (t - 1) / 2)
    few = F.struct("_v", F.col("_a").cast("int").alias("a"), F.col("_b").cast("int").alias("b"))
    out = placed.groupBy(*by).agg(
        F.sum("_a").alias("n1"), F.sum("_b").alias("n2"), F.sum(F.col("_a") * F.col("_rank")).alias("_r1"),
        F.sum(F.col("_t") * (F.col("_t") * F.col("_t") - 1)).alias("_ties"),
        # values up to the place that groups with an exact p end at
        F.collect_list(F.when(F.col("_upto") <= P.EXACT_RANK_TEST_N, few)).alias("_few"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, both = n1 + n2, (F.col("n1") > 0) & (F.col("n2") > 0)
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    u2 = n1 * n2 - u1
    correction = F.greatest(F.lit(0.0), 1 - ratio(F.col("_ties"), n * (n * n - 1)))
    sigma = F.sqrt(n1 * n2 * (n + 1) / 12) * F.sqrt(correction)
    z = F.coalesce(ratio(F.least(u1, u2) - n1 * n2 / 2, F.when(sigma > 0, sigma)), F.lit(0.0))
    out = out.withColumn("u1", F.when(both, u1)).withColumn("u2", F.when(both, u2)).withColumn("z", F.when(both, z))
    exact = exact_p(F.when(n <= P.EXACT_RANK_TEST_N, F.col("_few")), "n1")
    p = F.when(both & (n <= P.EXACT_RANK_TEST_N), exact).when(both, 2 * (1 - normal_cdf(F.abs("z"))))
    share = ratio(F.col("u2"), n1 * n2)
    low, high = wilson(share, n1 * n2)
    method = F.when(~both, "NA").when(n <= P.EXACT_RANK_TEST_N, "exact").otherwise("normal")
    return out.select(*by, "n1", "n2", F.least("u1", "u2").alias("u"), "z", p.alias("p"), (2 * share - 1).alias("effect"), F.when(both, 2 * low - 1).alias("effect_low"), F.when(both, 2 * high - 1).alias("effect_high"), method.alias("method"))


@F.pandas_udf(DoubleType())
def exact_p(few: pd.Series, n1: pd.Series) -> pd.Series:
    """The exact p from the few values of a group, each with its numbers in the two samples."""
    out = []
    for rows, n in zip(few, n1, strict=True):
        rows = sorted(rows, key=lambda r: r["_v"]) if rows is not None else []
        first, second, before = [], [], 0
        for r in rows:
            twice = 2 * before + r["a"] + r["b"] + 1
            first += [twice] * r["a"]
            second += [twice] * r["b"]
            before += r["a"] + r["b"]
        out.append(kernels.exact_rank_p(np.array(first + second), int(n)) if first and second else None)
    return pd.Series(out, dtype="float64")


def permutation_tests(df: DataFrame, x: str, y: str, by: list[str] = (), rounds: int = P.PERMUTATIONS, seed: int = 5, chunk: int = 100, spread: bool = True) -> DataFrame:
    """``by, p, n``: the share of random pairings at least as correlated in rank, the seen one among them; null under three pairs.

    A group is reduced to its distinct ranks and how often each occurs, for both sides, and the rounds of a group are dealt to
    many tasks, ``chunk`` each: what a task holds are the distinct values of a group, not its rows. Groups that are known to be
    small (``spread=False``) are drawn for as a whole.
    """
    by = list(by)
    pairs = _paired(df, x, y, by)
    if not spread:
        return _small_permutations(df, x, y, by, rounds, seed)
    ranked, *sides = _ranked(pairs, by, spread)
    seen = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_rx") * F.col("_ry")).alias("_s"))

    whole = seen.filter("_n > 2")
    for c, side in zip(("_rx", "_ry"), sides, strict=True):
        values = F.array_sort(F.collect_list(F.struct(F.col(c).alias("r"), F.col("_t"))))
        whole = scans.matched(whole, side.groupBy(*by).agg(values.alias(c)), by)
    arrays = [F.col(c)[k].alias(f"{c}{k}") for c in ("_rx", "_ry") for k in ("r", "_t")]
    parts = -(-rounds // chunk)
    dealt = whole.select(*by, "_n", "_s", *arrays, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    tasks = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name in by]

    def draw(frames):
        for pdf in frames:
            hits = []
            for n, s, ra, ta, rb, tb, part in pdf[["_n", "_s", "_rxr", "_rx_t", "_ryr", "_ry_t", "_part"]].itertuples(index=False, name=None):
                middle = (n + 1) / 2
                own = min(chunk, rounds - part * chunk)
                hits.append(kernels.permuted_hits(np.array(ra) - middle, np.array(ta), np.array(rb) - middle, np.array(tb), s - n * middle * middle, own, seed + int(part)))
            yield pdf[by].assign(_hits=hits)

    found = dealt.repartition(tasks, *by, "_part").mapInPandas(draw, ", ".join([*keys, "_hits bigint"]))
    found = found.groupBy(*by).agg(((1 + F.sum("_hits")) / (rounds + 1)).alias("p"))
    groups = scans.matched(df.select(*by).distinct(), seen, by) if by else seen
    out = scans.matched(groups, found, by)
    return out.select(*by, "p", F.coalesce("_n", F.lit(0)).alias("n"))


def _small_permutations(df: DataFrame, x: str, y: str, by: list[str], rounds: int, seed: int) -> DataFrame:
    slim = df.select(*by, finite(x).alias("_x"), finite(y).alias("_y"))
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, p = pdf.dropna(subset=["_x", "_y"]), None
        if len(own) > 2:
            a, b = (own[c].rank().to_numpy() - (len(own) + 1) / 2 for c in ("_x", "_y"))
            sides = [v for side in (a, b) for v in np.unique(side, return_counts=True)]
            p = (1 + kernels.permuted_hits(*sides, float(a @ b), rounds, seed)) / (rounds + 1)
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in by} | {"p": p, "n": len(own)}]).astype({"p": "float64"})

    found = slim.groupBy(*(by or [F.lit("").alias("_one")])).applyInPandas(run, ", ".join([*keys, "p double, n bigint"]))
    return found.withColumn("p", finite("p"))


def compare_ranges(df: DataFrame, day: str, values: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Means over two date ranges, their difference, and the rank test between them, for each value column."""
    d = F.to_date(day)
    inside = lambda r: d.between(F.lit(r[0]).cast("date"), F.lit(r[1]).cast("date"))
    long = df.select(d.alias("_d"), F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), finite(v).alias("v")) for v in values])).alias("t"), inside(a).alias("_a"), inside(b).alias("_b"))
    long = long.select("t.measure", "t.v", "_a", "_b").filter("_a or _b")
    means = long.groupBy("measure").agg(F.avg(F.when(F.col("_a"), F.col("v"))).alias("mean_a"), F.avg(F.when(F.col("_b"), F.col("v"))).alias("mean_b"))
    sides = long.select("measure", "v", F.explode(F.array_compact(F.array(F.when(F.col("_a"), F.lit(True)), F.when(F.col("_b"), F.lit(False))))).alias("_side"))
    tests = mann_whitney(sides, "v", F.col("_side"), ["measure"])
    return means.join(tests, "measure").withColumn("delta", F.col("mean_b") - F.col("mean_a"))


def grid_of(df: DataFrame, x: str, points: int = 60) -> DataFrame:
    ends = df.agg(F.min(finite(x)).alias("a"), F.max(finite(x)).alias("z")).filter("a is not null")
    step = F.sequence(F.lit(0), F.lit(points - 1))
    return ends.select("a", "z", F.posexplode(step).alias("point", "_k")).select("point", (F.col("a") + (F.col("z") - F.col("a")) * F.col("_k") / (points - 1)).alias("x0"))


def _near(df: DataFrame, x: str, y: str, grid: DataFrame, count) -> DataFrame:
    """For each grid point the rows that are no farther than its ``count``-th nearest, with their distance ``_d`` and the
    largest distance ``_far``.

    That distance is an order statistic of the distances from the point, so neither rows nor points are sorted. ``count`` is
    a function of the number of rows. Grid points are few and broadcast.
    """
    pts = _paired(df, x, y, [])
    met = pts.join(F.broadcast(grid.select("point", "x0"))).withColumn("_d", F.abs(F.col("_x") - F.col("x0")))
    kth = lambda n: (F.least(n, count(n)).cast("long") - 1,) * 2
    reach = scans.order_statistics(met.select(F.col("point").alias("_g"), F.col("_d").alias("_x")), {"k": kth})
    # a row for each grid point
    reach = F.broadcast(reach.select(F.col("_g").alias("_of"), F.try_element_at("_m", F.lit("k"))["lo"].alias("_far"), F.least("n", count(F.col("n"))).cast("long").alias("_k")))
    return met.join(reach, F.col("point") == F.col("_of")).filter("_d <= _far").drop("_of")


def loess(df: DataFrame, x: str, y: str, grid: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Local lines with tricube weights over the nearest ``alpha`` of all rows, at each ``x0`` of the grid.

    The farthest of these rows have weight 0, so it doesn't matter which of several equally far ones belong to them; only
    where more rows than wanted lie at the point itself do all of those count.
    """
    near = _near(df, x, y, grid, lambda n: F.greatest(F.lit(2), F.floor(F.lit(alpha) * n)))
    d = ratio(F.col("_d"), F.when(F.col("_far") > 0, F.col("_far")).otherwise(1.0))
    near = near.withColumn("_w", F.pow(F.greatest(F.lit(0.0), 1 - F.pow(d, F.lit(3.0))), F.lit(3.0)))
    # about the grid point, so the fitted value is the intercept
    u, v = F.col("_x") - F.col("x0"), F.col("_y")
    s = near.groupBy("point", "x0").agg(*[F.sum(F.col("_w") * e).alias(n) for n, e in (("s", F.lit(1.0)), ("sx", u), ("sy", v), ("sxx", u * u), ("sxy", u * v))])
    den = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.coalesce(ratio(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), F.when(F.abs(den) > 1e-12 * F.col("s") * F.col("sxx"), den)), F.lit(0.0))
    return s.select("point", "x0", F.coalesce(ratio(F.col("sy") - slope * F.col("sx"), F.col("s")), F.lit(0.0)).alias("y"))


def running_quantile(df: DataFrame, x: str, y: str, grid: DataFrame, q: float = 0.5, k: int = 25) -> DataFrame:
    """The quantile of the ``k`` nearest rows at each grid point; of two at one distance the one to the left, and of equal
    ones the one next to the point in the order of ``x`` and ``y``."""
    near = _near(df, x, y, grid, lambda n: F.greatest(F.lit(3), F.least(F.lit(k), n)))
    left = F.col("_x") < F.col("x0")
    order = ["_d", F.when(left, 0).otherwise(1), F.when(left, -F.col("_y")).otherwise(F.col("_y"))]
    # the k nearest and those as far as the last of them
    near = near.withColumn("_place", F.row_number().over(W.partitionBy("point").orderBy(*order))).filter(F.col("_place") <= k).filter("_place <= _k")
    return near.groupBy("point", "x0").agg(F.percentile("_y", F.lit(q)).alias("y"))


def benjamini_hochberg(df: DataFrame, p: str, key: str, by: list[str] = (), q: float = P.BH_Q, spread: bool = True) -> DataFrame:
    """Adjusted p-values within each family and whether a test survives; tests without a p take no part.

    Equal p-values have equal results, so the work is done on counts by p: places are running sums over slices of p, and the
    smallest ratio from a place on is a running minimum from the other end (windows over families that are known to be small,
    ``spread=False``).
    """
    by = list(by)
    x = df.withColumn("_p", finite(p))
    counts = x.filter("_p is not null").groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    if spread:
        placed = scans.running(scans.sliced(counts, "_p"), ["_p"], {"_k": F.col("_c")}, by=by)
        placed = scans.matched(placed, counts.groupBy(*by).agg(F.sum("_c").alias("_m")), by)
    else:
        family = W.partitionBy(*by)
        placed = counts.withColumns({"_k": F.sum("_c").over(family.orderBy("_p")), "_m": F.sum("_c").over(family)})
    # of equal p-values the last has the smallest ratio
    placed = placed.withColumns({"_q": F.col("_p") * F.col("_m") / F.col("_k"), "_n": -F.col("_p")})
    if spread:
        placed = scans.running(scans.sliced(placed.drop("_s"), "_n"), ["_n"], maxima={"_least": -F.col("_q")}, by=by)
    else:
        placed = placed.withColumn("_least", F.max(-F.col("_q")).over(W.partitionBy(*by).orderBy("_n")))
    passes = F.col("_p") <= F.col("_k") / F.col("_m") * q
    placed = placed.select(*by, "_p", F.least(F.lit(1.0), -F.col("_least")).alias("q_value"), F.when(passes, F.col("_p")).alias("_cut"))
    if spread:
        placed = scans.matched(placed, placed.groupBy(*by).agg(F.max("_cut").alias("_last")), by)
    else:
        placed = placed.withColumn("_last", F.max("_cut").over(W.partitionBy(*by)))
    placed = placed.select(*by, "_p", "q_value", F.coalesce(F.col("_p") <= F.col("_last"), F.lit(False)).alias("survives"))
    tests = scans.matched(x, placed, [*by, "_p"])
    return tests.withColumn("survives", F.coalesce("survives", F.lit(False))).drop("_p")


def heavy_ties(df: DataFrame, columns: list[str], by: list[str] = (), share: float = P.HEAVY_TIES) -> DataFrame:
    """Whether in any of the columns one value takes more than ``share`` of the rows."""
    by = list(by)
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), finite(c).alias("v")) for c in columns])).alias("t")).filter("t.v is not null")
    counts = long.groupBy(*by, "t.c", "t.v").agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy(*by, "c").agg((F.max("n") / F.sum("n")).alias("top"))
    return each.groupBy(*by).agg((F.max("top") > share).alias("heavy"), F.max("top").alias("top_share"))


def strongest(pairs: DataFrame, r: str, by: list[str] = ()) -> DataFrame:
    """The pair with the largest absolute correlation; the first by name among equals."""
    best = F.max_by(F.struct("x", "y", F.col(r).alias("r")), F.struct(F.abs(r), F.col("x"), F.col("y")))
    return pairs.filter(F.col(r).isNotNull() & (F.col("x") < F.col("y"))).groupBy(*by).agg(best.alias("b")).select(*by, "b.*")
