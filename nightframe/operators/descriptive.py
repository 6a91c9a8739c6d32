"""Nightly and event summaries. ``by`` names the columns that separate series; without them all rows are one series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nightframe import params as P
from nightframe.functions.exprs import col, finite, fixed, ratio, severity_band
from nightframe.operators import scans


def quantile(c: str | Column, q: float) -> Column:
    """Linear interpolation between order statistics; NULL over no rows."""
    return F.percentile(col(c), F.lit(q))


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], by: list[str] = (), spread: bool = False) -> DataFrame:
    """``n`` and the quantiles by name. ``spread`` is for series of any length: there no task sees a whole series."""
    if spread:
        return _spread_quantiles(df, value, probabilities, list(by))
    x = df.withColumn("_x", finite(value))
    return x.groupBy(*by).agg(F.count("_x").alias("n"), *[quantile("_x", q).alias(name) for name, q in probabilities.items()])


def _spread_quantiles(df: DataFrame, value: str, probabilities: dict[str, float], by: list[str]) -> DataFrame:
    """The same from the two order statistics around each quantile."""
    series = F.struct(*by) if by else F.struct(F.lit(0).alias("_one"))
    place = lambda n, q: (n - 1) * F.lit(float(q))
    asked = {name: lambda n, q=q: (F.floor(place(n, q)), F.ceil(place(n, q))) for name, q in probabilities.items()}
    found = scans.order_statistics(df.select(series.alias("_g"), finite(value).alias("_x")), asked)
    if not by:  # one row, even of an empty table
        found = df.sparkSession.range(1).select(series.alias("_of")).join(F.broadcast(found), F.col("_of") == F.col("_g"), "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def between(name: str, q: float) -> Column:
        ends = F.try_element_at("_m", F.lit(name))
        part = place(F.col("n"), q) - F.floor(place(F.col("n"), q))
        return ((1 - part) * ends["lo"] + part * ends["hi"]).alias(name)

    return found.select(*[F.col("_g")[c].alias(c) for c in by], F.col("n").cast("bigint").alias("n"), *[between(name, q) for name, q in probabilities.items()])


def median_iqr(df: DataFrame, value: str, by: list[str] = (), spread: bool = False) -> DataFrame:
    out = quantiles(df, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}, by, spread)
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def _with_fences(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Each row with its series' quartiles; the quartiles are one row for each series."""
    x = df.withColumn("_x", finite(value))
    fences = x.groupBy(*by).agg(*[quantile("_x", q).alias(n) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))])
    # without ``by`` the right side is a single row
    return x.join(fences, list(by)) if by else x.join(F.broadcast(fences))


def usage_summary(df: DataFrame, hours: str, by: list[str] = ()) -> DataFrame:
    """Counts of valid and long nights, centre, spread, and outliers strictly outside the fences."""
    by = list(by)
    x = _with_fences(df, hours, by)
    iqr = F.col("p75") - F.col("p25")
    v = F.col("_x")
    out = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_nights"),
        F.count(v).alias("valid_nights"),
        F.sum((v >= P.USAGE_HOURS).cast("int")).alias("nights_long"),
        F.sum((v >= P.USAGE_HOURS_STRICT).cast("int")).alias("nights_long6"),
        F.sum((v < P.USAGE_HOURS).cast("int")).alias("nights_short"),
        F.avg(v).alias("avg_hours"),
        F.min(v).alias("min_hours"),
        F.max(v).alias("max_hours"),
        F.first("median").alias("median_hours"),
        F.first("p25").alias("p25_hours"),
        F.first("p75").alias("p75_hours"),
        F.first(iqr).alias("iqr_hours"),
        F.sum((v < F.col("p25") - P.IQR_FACTOR * iqr).cast("int")).alias("outlier_low"),
        F.sum((v > F.col("p75") + P.IQR_FACTOR * iqr).cast("int")).alias("outlier_high"),
    )
    zero = ["nights_long", "nights_long6", "nights_short", "outlier_low", "outlier_high"]
    out = out.fillna(0, zero)
    return out.withColumn("invalid_nights", F.col("total_nights") - F.col("valid_nights"))


def first_last(df: DataFrame, day: str, value: str, by: list[str] = (), rows: int = P.TREND_ROWS) -> DataFrame:
    """Means over the first and the last rows by day; the rows are taken first, then missing values drop out.

    Ranks come from the ``rows`` smallest and largest days of each series, which partial aggregation bounds.
    """
    x = df.withColumn("_x", finite(value))
    pair = F.struct(F.col(day).alias("d"), F.col("_x").alias("x"))
    if by:
        w = W.partitionBy(*by)
        x = x.withColumn("_a", F.row_number().over(w.orderBy(day))).withColumn("_z", F.row_number().over(w.orderBy(F.desc(day))))
        return x.groupBy(*by).agg(F.avg(F.when(F.col("_a") <= rows, F.col("_x"))).alias("first_mean"), F.avg(F.when(F.col("_z") <= rows, F.col("_x"))).alias("last_mean"))
    head = x.select(pair.alias("p")).orderBy("p.d").limit(rows).agg(F.avg("p.x").alias("first_mean"))
    tail = x.select(pair.alias("p")).orderBy(F.desc("p.d")).limit(rows).agg(F.avg("p.x").alias("last_mean"))
    return head.join(F.broadcast(tail))


def ahi_trends(df: DataFrame, day: str, ahi: str, by: list[str] = ()) -> DataFrame:
    x = df.withColumn("_x", finite(ahi))
    out = x.groupBy(*by).agg(
        F.avg("_x").alias("avg_ahi"),
        F.min("_x").alias("min_ahi"),
        F.max("_x").alias("max_ahi"),
        *[quantile("_x", q).alias(n) for n, q in (("p25_ahi", 0.25), ("median_ahi", 0.5), ("p75_ahi", 0.75))],
        F.count(F.when(F.col("_x") > P.AHI_BANDS[0], 1)).alias("nights_over5"),
    ).withColumn("iqr_ahi", F.col("p75_ahi") - F.col("p25_ahi"))
    ends = first_last(df, day, ahi, by)
    ends = ends.withColumnsRenamed({"first_mean": "first30_ahi", "last_mean": "last30_ahi"})
    return out.join(ends, list(by)) if by else out.join(F.broadcast(ends))


def pair_sums(x: Column, y: Column, prefix: str = "") -> list[Column]:
    """Aggregates for the correlation of a pair, over rows that have both."""
    both = x.isNotNull() & y.isNotNull()
    on = lambda c: F.when(both, c)
    terms = {"n": on(F.lit(1.0)), "sx": on(x), "sy": on(y), "sxx": on(x * x), "syy": on(y * y), "sxy": on(x * y)}
    return [F.sum(c).alias(f"{prefix}{name}") for name, c in terms.items()]


def epap_trends(df: DataFrame, day: str, epap: str, ahi: str) -> DataFrame:
    from nightframe.operators.inference import pearson

    x = df.withColumn("_e", finite(epap)).withColumn("_a", finite(ahi))
    out = x.agg(
        F.min("_e").alias("min_epap"),
        F.max("_e").alias("max_epap"),
        *[quantile("_e", q).alias(n) for n, q in (("p25_epap", 0.25), ("median_epap", 0.5), ("p75_epap", 0.75))],
        F.avg(F.when(F.col("_e") < P.EPAP_SPLIT, F.col("_a"))).alias("avg_ahi_low"),
        F.avg(F.when(F.col("_e") >= P.EPAP_SPLIT, F.col("_a"))).alias("avg_ahi_high"),
        F.count(F.when((F.col("_e") < P.EPAP_SPLIT) & F.col("_a").isNotNull(), 1)).alias("n_low"),
        F.count(F.when((F.col("_e") >= P.EPAP_SPLIT) & F.col("_a").isNotNull(), 1)).alias("n_high"),
    ).withColumn("iqr_epap", F.col("p75_epap") - F.col("p25_epap"))
    ends = first_last(df, day, epap).withColumnsRenamed({"first_mean": "first30_epap", "last_mean": "last30_epap"})
    r = pearson(x, "_e", "_a", least=2).select(F.col("r").alias("corr_epap_ahi"))
    return out.join(F.broadcast(ends)).join(F.broadcast(r))


def event_stats(events: DataFrame, ts: str, duration: str) -> DataFrame:
    """Durations of events with inclusive outlier fences, and the spread of counts over calendar dates."""
    points = {"p25_sec": 0.25, "median_sec": 0.5, "p75_sec": 0.75, "p95_sec": 0.95}
    # one row
    middle = F.broadcast(quantiles(events, duration, points, spread=True).drop("n"))
    x = events.select(finite(duration).alias("_x")).join(middle)
    v, iqr = F.col("_x"), F.col("p75") - F.col("p25")
    out = x.agg(
        F.count(v).alias("total_events"),
        F.avg(v).alias("avg_sec"),
        F.min(v).alias("min_sec"),
        F.max(v).alias("max_sec"),
        *[F.first(n).alias(n) for n in points],
        F.count(F.when(v > P.LONG_EVENT_SEC, 1)).alias("over30"),
        F.count(F.when(v > P.VERY_LONG_EVENT_SEC, 1)).alias("over60"),
        F.count(F.when(v >= F.col("p75_sec") + P.IQR_FACTOR * (F.col("p75_sec") - F.col("p25_sec")), 1)).alias("outlier_events"),
    )
    nights = events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("c"))
    n = _with_fences(nights, "c", [])
    by_night = n.agg(
        F.count(F.lit(1)).alias("nights"),
        F.max("median").alias("median_per_night"),
        F.max("p25").alias("p25_per_night"),
        F.max("p75").alias("p75_per_night"),
        F.min("_x").alias("min_per_night"),
        F.max("_x").alias("max_per_night"),
        F.count(F.when(F.col("_x") >= F.col("p75") + P.IQR_FACTOR * iqr, 1)).alias("outlier_nights_high"),
        F.count(F.when(F.col("_x") <= F.col("p25") - P.IQR_FACTOR * iqr, 1)).alias("outlier_nights_low"),
    )
    return out.join(F.broadcast(by_night))


def event_shares(events: DataFrame, duration: str) -> DataFrame:
    v = finite(duration)
    return events.agg(F.count(v).alias("n"), (100 * ratio(F.count(F.when(v > P.LONG_EVENT_SEC, 1)), F.count(v))).alias("pct_over30"), (100 * ratio(F.count(F.when(v > P.VERY_LONG_EVENT_SEC, 1)), F.count(v))).alias("pct_over60"))


def severity_bands(df: DataFrame, ahi: str, by: list[str] = ()) -> DataFrame:
    x = df.withColumn("band", severity_band(finite(ahi))).filter("band is not null")
    return x.groupBy(*by, "band").agg(F.count(F.lit(1)).alias("nights"))


def kpis(df: DataFrame, day: str, hours: str, last_days: int = 30) -> DataFrame:
    """Shares of nights of at least 4 and 6 hours, over all nights and over the last days before the latest."""
    x = df.withColumn("_x", finite(hours))
    end = x.agg(F.max(day).alias("_end"))
    x = x.join(F.broadcast(end))
    late = F.col(day) > F.date_sub("_end", last_days)
    share = lambda t, on: 100 * ratio(F.count(F.when(on & (F.col("_x") >= t), 1)), F.count(F.when(on, F.col("_x"))))
    everything = F.lit(True)
    return x.agg(share(P.USAGE_HOURS, everything).alias("pct_4h"), share(P.USAGE_HOURS_STRICT, everything).alias("pct_6h"), share(P.USAGE_HOURS, late).alias("pct_4h_last30"), F.count("_x").alias("nights"))


def usage_stats(df: DataFrame, hours: str) -> DataFrame:
    """Quartiles, range, and the number of bins by Freedman and Diaconis (12 if the rule gives none)."""
    x = df.withColumn("_x", finite(hours)).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), *[quantile("_x", q).alias(n) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))])
    iqr, span = F.col("p75") - F.col("p25"), F.col("hi") - F.col("lo")
    width = F.when((iqr > 0) & (F.col("n") > 0), 2 * iqr / F.pow(F.col("n").cast("double"), 1 / 3))
    bins = F.when(width > 0, F.greatest(F.lit(1), F.ceil(ratio(span, width)).cast("int"))).otherwise(12)
    return x.select("n", "mean", "p25", "median", "p75", iqr.alias("iqr"), span.alias("range"), F.coalesce(bins, F.lit(12)).cast("long").alias("nbins"))


def bin_of(c: Column, lo: Column | float, hi: Column | float, bins: int) -> Column:
    """Bins from 0; the upper end belongs to the last."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    k = F.floor((c - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins)
    return F.when(hi == lo, 0).otherwise(F.least(F.greatest(k, F.lit(0)), F.lit(bins - 1))).cast("long")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    x = df.withColumn("_x", finite(value)).filter("_x is not null")
    ends = x.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    x = x.join(F.broadcast(ends))
    return x.groupBy(bin_of(F.col("_x"), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first(F.col("_lo")).alias("lo"), F.first(F.col("_hi")).alias("hi"))


def histogram2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    both = df.withColumn("_x", finite(x)).withColumn("_y", finite(y)).filter("_x is not null and _y is not null")
    ends = both.agg(F.min("_x").alias("_xl"), F.max("_x").alias("_xh"), F.min("_y").alias("_yl"), F.max("_y").alias("_yh"))
    both = both.join(F.broadcast(ends))
    return both.groupBy(bin_of(F.col("_x"), F.col("_xl"), F.col("_xh"), bins).alias("bx"), bin_of(F.col("_y"), F.col("_yl"), F.col("_yh"), bins).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def box(df: DataFrame, value: str, by: list[str], spread: bool = False) -> DataFrame:
    return quantiles(df, value, {"lo": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "hi": 1.0}, by, spread)


def pivot(df: DataFrame, by: str) -> DataFrame:
    """Count and the mean of every numeric column for each value of ``by``, as text; null is the empty text."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint")
    numeric = [c for c, k in df.dtypes if k in kinds or k.startswith("decimal")]
    key = F.coalesce(F.col(by).cast("string"), F.lit("")).alias("group")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(finite(c)).alias(f"mean_{c}") for c in numeric if c != by])


def aggregates_csv(summary: DataFrame, lines: dict[str, tuple[str, int]]) -> DataFrame:
    """One row of figures as ``metric, value`` lines with fixed decimals; ``lines`` maps labels to (column, decimals)."""
    pairs = [F.struct(F.lit(label).alias("metric"), fixed(c, d).alias("value")) for label, (c, d) in lines.items()]
    return summary.select(F.explode(F.array(*pairs)).alias("p")).select("p.metric", "p.value")


def outlier_share(df: DataFrame, ahi: str) -> DataFrame:
    """Nights at or above the upper fence, and shares of nights by band, over nights that have a value."""
    x = _with_fences(df, ahi, [])
    v, n = F.col("_x"), F.count("_x")
    high = F.count(F.when(v >= F.col("p75") + P.IQR_FACTOR * (F.col("p75") - F.col("p25")), 1))
    return x.agg(n.alias("valid"), high.alias("outliers"), *[(100 * ratio(F.count(F.when(v > t, 1)), n)).alias(f"pct_over{int(t)}") for t in P.AHI_BANDS])
