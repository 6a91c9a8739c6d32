"""Operators on ordered series: rolling windows, streaks, decomposition, lags.

``by`` separates series. With ``spread``, which is the default without ``by``, a series of any length is cut into blocks or
slices (``scans``) and no task sees all of it; else ``by`` is the partitioning of every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nightframe import params as P
from nightframe.functions.exprs import day_number, finite, normal_quantile, ratio
from nightframe.operators import scans

#: Days or rows of a block; blocks are longer where a frame is.
BLOCK = 1024


def _spread(spread: bool | None, by: list[str]) -> bool:
    return not by if spread is None else spread


def rolling(df: DataFrame, day: str, value: str, days: int, by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Over the last ``days`` calendar days of each row: mean with its interval, median with its order-statistic
    interval, and the share of nights of at least four hours. Missing values count nowhere.

    Spread out, a block of days also gets the days before it that its frames reach, and returns its own rows only.
    """
    x = df.withColumn("_d", day_number(day)).withColumn("_x", finite(value))
    apart = _spread(spread, by)
    if apart:
        # rows without a date have a frame of their own
        x = scans.with_halo(x.withColumn("_p", F.coalesce("_d", F.lit(-(2**40)))), "_p", days - 1, 0, max(BLOCK, 8 * days))
    w = W.partitionBy(*by, *["_at"] * apart).orderBy("_d").rangeBetween(-(days - 1), 0)
    x = x.withColumn("_n", F.count("_x").over(w)).withColumn("_s", F.sort_array(F.collect_list("_x").over(w)))
    x = x.withColumn("_m", F.avg("_x").over(w)).withColumn("_sd", F.stddev_samp("_x").over(w))
    x = x.withColumn("_c", F.sum((F.col("_x") >= P.USAGE_HOURS).cast("int")).over(w))
    n, half = F.col("_n"), P.Z * F.col("_sd") / F.sqrt("_n")
    spread = P.Z * F.sqrt(n * 0.25)
    low = F.greatest(F.lit(0), F.floor(n * 0.5 - spread)).cast("int")
    high = F.least(n - 1, F.ceil(n * 0.5 + spread)).cast("int")
    mid = F.floor((n - 1) / 2).cast("int")
    median = F.when(n % 2 == 1, F.get("_s", mid)).otherwise((F.get("_s", mid) + F.get("_s", mid + 1)) / 2)
    return (x.filter("_own") if apart else x).select(
        *by, day, F.col("_x").alias("value"), n.alias("n"),
        F.col("_m").alias("avg"), (F.col("_m") - half).alias("avg_low"), (F.col("_m") + half).alias("avg_high"),
        F.when(n > 0, median).alias("median"), F.get("_s", low).alias("median_low"), F.get("_s", high).alias("median_high"),
        (100 * ratio(F.col("_c"), n)).alias("pct_4h"),
    )


def streaks(df: DataFrame, day: str, value: str, thresholds: list[float], by: list[str] = ()) -> DataFrame:
    """The longest run of rows at or above each threshold; gaps between dates don't end a run."""
    x = df.select(*by, day, finite(value).alias("_x"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    key = [*by, "threshold"]
    x = x.withColumn("_ok", F.coalesce(F.col("_x") >= F.col("threshold"), F.lit(False)))
    run = F.row_number().over(W.partitionBy(*key).orderBy(day)) - F.row_number().over(W.partitionBy(*key, "_ok").orderBy(day))
    runs = x.withColumn("_run", run).groupBy(*key, "_ok", "_run").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("_ok"), F.col("_n"))), F.lit(0)).alias("longest"))


def breakpoints(df: DataFrame, day: str, short: str, long: str, least: float = 0.75, by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Days on which the difference of two rolling means changes its sign, where it is at least ``least``."""
    x = df.withColumn("_d", finite(short) - finite(long))
    if _spread(spread, by):
        x = scans.sliced(x.withColumn("_k", day_number(day)), "_k")
        x = scans.preceding(x, ["_k"], {"_p": F.col("_d")}, by)
    else:
        x = x.withColumn("_p", F.lag("_d").over(W.partitionBy(*by).orderBy(day)))
    turned = (F.signum("_d") != F.signum("_p")) & (F.abs("_d") >= least)
    return x.filter(turned).select(*by, day, F.col("_d").alias("delta"))


def decompose(df: DataFrame, day: str, value: str, season: int = P.SEASON, by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Trend (centred moving mean), seasonal part (mean of the detrended values at each place of the season, centred)
    and the rest."""
    by, half = list(by), max(1, season // 2)
    x = _numbered(df, day, value, by, spread, [day]).withColumnRenamed("_x", "value")
    x = scans.with_halo(x, "_i", half, half, max(BLOCK, 8 * half)) if _spread(spread, by) else x.withColumns({"_at": F.lit(0), "_own": F.lit(True)})
    order = W.partitionBy(*by, "_at").orderBy("_i")
    x = x.withColumn("trend", F.avg("value").over(order.rowsBetween(-half, half))).filter("_own").withColumn("_place", F.pmod("_i", F.lit(season)))
    means = x.groupBy(*by, "_place").agg(F.avg(F.col("value") - F.col("trend")).alias("_mean"))
    all_of = W.partitionBy(*by)
    # as many rows as the season has places
    pattern = means.withColumn("seasonal", F.coalesce("_mean", F.lit(0.0)) - F.avg(F.coalesce("_mean", F.lit(0.0))).over(all_of)).drop("_mean")
    x = x.join(F.broadcast(pattern) if not by else pattern, [*by, "_place"])
    return x.select(*by, day, "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def _numbered(df: DataFrame, day: str, value: str, by: list[str], spread: bool | None, more: list[str] = ()) -> DataFrame:
    """``by, _i, _x``: values in order of the day, numbered from 0."""
    x = df.select(*by, *more, day_number(day).alias("_k"), finite(value).alias("_x"))
    if _spread(spread, by):
        return scans.numbered(x, "_k", by)
    return x.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("_k")) - 1)


def autocorrelation(df: DataFrame, day: str, value: str, lags: int = 30, by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Autocorrelation by lag about the series' mean, over the pairs that have both values.

    All lags come from one pass: a row meets its ``lags`` predecessors in one window frame. Spread out, a block of rows
    also gets the ``lags`` rows before it.
    """
    by = list(by)
    x = _numbered(df, day, value, by, spread)
    means = df.groupBy(*by).agg(F.avg(finite(value)).alias("_mean"))
    if by:
        same = F.lit(True)
        for b in by:
            same &= F.col(b).eqNullSafe(F.col(f"_m_{b}"))
        x = x.join(means.withColumnsRenamed({b: f"_m_{b}" for b in by}), same).drop(*[f"_m_{b}" for b in by])
    else:
        x = x.join(F.broadcast(means))
    x = x.withColumn("_c", F.col("_x") - F.col("_mean"))
    x = scans.with_halo(x, "_i", lags, 0, max(BLOCK, 8 * lags)) if _spread(spread, by) else x.withColumns({"_at": F.lit(0), "_own": F.lit(True)})
    order = W.partitionBy(*by, "_at").orderBy("_i")
    before = [F.struct(F.lit(k).alias("lag"), (F.col("_c") * F.lag("_c", k).over(order)).alias("p")) for k in range(lags + 1)]
    own = x.select(*by, "_c", "_own", F.array(*before).alias("_all")).filter("_own")
    total = own.groupBy(*by).agg(F.sum(F.col("_c") * F.col("_c")).alias("_ss"), F.count(F.lit(1)).alias("_rows"))
    products = own.select(*by, F.explode("_all").alias("t")).groupBy(*by, F.col("t.lag").alias("lag"))
    sums = products.agg(F.sum("t.p").alias("_sp"), F.count("t.p").alias("pairs"))
    out = sums.join(total, by) if by else sums.join(F.broadcast(total))
    kept = out.filter(F.col("lag") < F.col("_rows"))
    conf = F.lit(P.Z) / F.sqrt(F.col("_rows").cast("double"))
    return kept.select(*by, F.col("lag").cast("int").alias("lag"), F.when(F.col("pairs") > 0, ratio(F.col("_sp"), F.col("_ss"))).alias("acf"), F.col("pairs").cast("long").alias("pairs"), conf.alias("conf"))


def correlogram(df: DataFrame, day: str, value: str, lags: int = 30, by: list[str] = ()) -> DataFrame:
    """``autocorrelation`` as it is drawn: without lag 0, and with as many lags as there are rows but one at most."""
    return autocorrelation(df, day, value, lags, by).filter("lag > 0")


def cross_correlation(df: DataFrame, day: str, x: str, y: str, lags: int = P.LAGS) -> DataFrame:
    """Pearson's correlation of ``x`` with ``y`` that many rows later, by position."""
    order = W.orderBy(day)
    n = F.count(F.lit(1)).over(W.partitionBy())
    both = df.select(finite(x).alias("_x"), finite(y).alias("_y"), day, n.alias("_n"))
    later = lambda k: F.lead("_y", k) if k >= 0 else F.lag("_y", -k)
    moved = both.select("_x", "_n", F.array(*[F.struct(F.lit(k).alias("lag"), later(k).over(order).alias("y")) for k in range(-lags, lags + 1)]).alias("t"))
    long = moved.select("_x", "_n", F.explode("t").alias("t")).select("_x", "_n", F.col("t.lag").alias("lag"), F.col("t.y").alias("_y"))
    from nightframe.operators.inference import pearson

    out = pearson(long, "_x", "_y", ["lag"])
    size = long.groupBy("lag").agg((P.Z / F.sqrt(F.max("_n").cast("double"))).alias("conf"))
    return out.join(size, "lag").select("lag", "r", "n", "conf")


def rank_table(df: DataFrame, value: str, by: list[str], name: str = "rank", spread: bool = True) -> DataFrame:
    """``by, _v``, the average rank of each value and how often it occurs (``_t``). Ties cost one row each; ranks are running
    sums over slices of the values, or over a group where groups are known to be small (``spread=False``)."""
    counts = df.select(*by, finite(value).alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_t"))
    if spread:
        counts = scans.running(scans.sliced(counts, "_v"), ["_v"], {"_upto": F.col("_t")}, by=by)
    else:
        counts = counts.withColumn("_upto", F.sum("_t").over(W.partitionBy(*by).orderBy("_v")))
    return counts.select(*by, "_v", (F.col("_upto") - (F.col("_t") - 1) / 2).cast("double").alias(name), "_t")


def ranks(df: DataFrame, value: str, by: list[str] = (), name: str = "rank", spread: bool = True) -> DataFrame:
    """Average ranks; missing values have none (see ``rank_table``)."""
    by = list(by)
    return scans.matched(df.withColumn("_v", finite(value)), rank_table(df, value, by, name, spread).drop("_t"), [*by, "_v"]).drop("_v")


def qq_points(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Sorted values against the normal quantiles of their places."""
    by = list(by)
    x = df.select(*by, finite(value).alias("value")).filter("value is not null")
    all_of = W.partitionBy(*by)
    x = x.withColumn("_n", F.count(F.lit(1)).over(all_of)).withColumn("_m", F.avg("value").over(all_of)).withColumn("_s", F.stddev_samp("value").over(all_of))
    x = x.withColumn("place", F.row_number().over(all_of.orderBy("value")))
    return x.select(*by, "place", "value", (F.col("_m") + F.col("_s") * normal_quantile(F.col("place") / (F.col("_n") + 1))).alias("theoretical"))


def survival(df: DataFrame, duration: str, by: list[str] = ()) -> DataFrame:
    """The share of events that last longer, by duration, with log-log limits; nothing is censored."""
    by = list(by)
    t = df.select(*by, finite(duration).alias("time")).filter("time >= 0").groupBy(*by, "time").agg(F.count(F.lit(1)).alias("d"))
    order = W.partitionBy(*by).orderBy("time")
    t = t.withColumn("_n", F.sum("d").over(W.partitionBy(*by))).withColumn("_cum", F.sum("d").over(order))
    at_risk = F.col("_n") - F.col("_cum") + F.col("d")
    term = F.when(at_risk > F.col("d"), F.col("d") / (at_risk * (at_risk - F.col("d"))).cast("double"))
    t = t.withColumn("at_risk", at_risk).withColumn("survival", 1 - F.col("_cum") / F.col("_n")).withColumn("_g", F.sum(F.coalesce(term, F.lit(0.0))).over(order))
    inside = (F.col("survival") > 0) & (F.col("survival") < 1)
    log_s = F.when(inside, F.ln("survival"))
    se = F.sqrt("_g") / F.abs(log_s)
    limit = lambda sign: F.exp(-F.exp(F.ln(-log_s) + sign * P.Z * se))
    return t.select(*by, "time", "d", "at_risk", "survival", limit(1).alias("lower"), limit(-1).alias("upper"))


def calendar(df: DataFrame, day: str, value: str, most_weeks: int = 600) -> DataFrame:
    """Weeks (from Monday) by weekday, every day of every week from the first to the last, at most the last ``most_weeks``."""
    days = df.select(F.to_date(day).alias("day"), finite(value).alias("value")).filter("day is not null").groupBy("day").agg(F.last("value").alias("value"))
    ends = days.agg(F.to_date(F.date_trunc("week", F.min("day"))).alias("a"), F.to_date(F.date_trunc("week", F.max("day"))).alias("z"))
    first = F.greatest(F.col("a"), F.date_sub("z", 7 * (most_weeks - 1)))
    spine = ends.filter("a is not null").select(F.explode(F.sequence(first, F.date_add("z", 6))).alias("day"))
    out = spine.join(days, "day", "left")
    return out.select(F.to_date(F.date_trunc("week", "day")).alias("week"), F.weekday("day").alias("dow"), "value")


def adherence(df: DataFrame, hours: str) -> DataFrame:
    x = finite(hours)
    n = F.count(x)
    return df.agg(n.alias("nights"), F.avg(x).alias("mean_hours"), (100 * ratio(F.count(F.when(x >= P.USAGE_HOURS, 1)), n)).alias("pct_4h"), (100 * ratio(F.count(F.when(x >= P.USAGE_HOURS_STRICT, 1)), n)).alias("pct_6h"))


def sparkline(df: DataFrame, day: str, value: str, by: list[str] = ()) -> DataFrame:
    """Values scaled to 0..1; a constant series gives 0."""
    all_of = W.partitionBy(*by)
    x = df.select(*by, day, finite(value).alias("_x")).filter("_x is not null")
    lo, hi = F.min("_x").over(all_of), F.max("_x").over(all_of)
    return x.select(*by, day, ((F.col("_x") - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo)).alias("y"))


def dense_days(df: DataFrame, day: str, values: list[str], most_days: int | None = None) -> DataFrame:
    """Every calendar day from the first to the last, missing ones with nulls; with ``most_days`` only the first so many."""
    days = df.select(F.to_date(day).alias("day"), *values)
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("z")).filter("a is not null")
    last = F.col("z") if most_days is None else F.least(F.col("z"), F.date_add("a", most_days - 1))
    spine = ends.select(F.explode(F.sequence(F.col("a"), last)).alias("day"))
    return spine.join(days, "day", "left")


def lag_profile(df: DataFrame, day: str, x: str, y: str, lags: int = P.LAGS, least: int = 3, by: list[str] = ()) -> DataFrame:
    """Spearman's correlation of ``x`` with ``y`` so many calendar days later, for every lag from -lags to lags."""
    from nightframe.operators.inference import spearman

    by = list(by)
    days = df.select(*by, F.to_date(day).alias("_day"), finite(x).alias("_x"), finite(y).alias("_y"))
    left = days.filter("_x is not null").select(*by, "_day", "_x", F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"))
    left = left.withColumn("_on", F.date_add("_day", F.col("lag")))
    right = days.filter("_y is not null").select(*by, F.col("_day").alias("_on"), "_y")
    return spearman(left.join(right, [*by, "_on"]), "_x", "_y", [*by, "lag"], least, spread=False).withColumnRenamed("r", "rho")


def effective_n(n: Column, r1x: Column, r1y: Column) -> Column:
    """The number of independent pairs that autocorrelated ones are worth, from 2 to n."""
    product = r1x * r1y
    return F.greatest(F.lit(2.0), F.least(n.cast("double"), n * ratio(1 - product, 1 + product)))


def first_lag(df: DataFrame, day: str, value: str, by: list[str]) -> DataFrame:
    """Correlation of neighbouring rows (lag 1) of each series."""
    order = W.partitionBy(*by).orderBy(day)
    x = df.select(*by, finite(value).alias("_x"), F.lag(finite(value)).over(order).alias("_p"))
    both = F.col("_x").isNotNull() & F.col("_p").isNotNull()
    mean = x.withColumn("_m", F.avg("_x").over(W.partitionBy(*by)))
    c, p = F.col("_x") - F.col("_m"), F.col("_p") - F.col("_m")
    return mean.groupBy(*by).agg(ratio(F.sum(F.when(both, c * p)), F.sum(c * c)).alias("r1"))


