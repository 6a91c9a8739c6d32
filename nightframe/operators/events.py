"""Event logs: clusters, flow-limited stretches, false negatives, and joins of events with intervals.

``by`` names the columns that separate subjects; every window and join is partitioned by them. With ``spread``, which is the
default without ``by``, a subject's log is cut into slices of time (``scans``), and only what a slice hands on (its last
end, the latest sample, how many clusters it began) reaches the next. Times are instants or wall-clock timestamps,
durations and gaps are seconds.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nightframe import params as P
from nightframe.functions.exprs import cluster_severity, density, finite, iso_instant
from nightframe.operators import kernels, scans


def seconds(ts: Column | str) -> Column:
    """A timestamp as seconds with fractions."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) / 1e6


def apnea_events(details: DataFrame, event: str, ts: str, value: str, by: list[str] = (), types: tuple[str, ...] = P.APNEA_TYPES) -> DataFrame:
    """``by, t, dur``: start in seconds and duration of the events of the given types."""
    return details.filter(F.col(event).isin(*types)).select(*by, seconds(ts).alias("t"), F.coalesce(finite(value), F.lit(0.0)).alias("dur")).filter("t is not null")


def flow_samples(details: DataFrame, event: str, ts: str, level: Column | str, by: list[str] = (), flow: str = P.FLOW_TYPE) -> DataFrame:
    """``by, t, level`` of the flow-limitation samples."""
    return details.filter(F.col(event) == flow).select(*by, seconds(ts).alias("t"), finite(level).alias("level")).filter("t is not null and level is not null")


def scan_filter(details: DataFrame, event: str, level: str, types: tuple[str, ...] = P.APNEA_TYPES, flow: str = P.FLOW_TYPE, least: float = 0.1) -> DataFrame:
    """What clustering needs of a log: the event types, and flow limitation from ``least`` up."""
    return details.filter(F.col(event).isin(*types) | ((F.col(event) == flow) & (finite(level) >= least)))


def _spread(spread: bool | None, by: list[str]) -> bool:
    return not by if spread is None else spread


def _counted(line: DataFrame, order: list[str], new: Column, by: list[str], name: str) -> DataFrame:
    """Slices of a log with the running number of the rows that begin something new."""
    return scans.running(line.withColumn("_new", new), order, {name: F.col("_new")}, by=by).drop("_new", "_s")


def gap_clusters(events: DataFrame, gap: float, by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Numbers clusters within each subject: an event that begins more than ``gap`` after the end of the one before it
    begins a new one."""
    if _spread(spread, by):
        x = scans.preceding(scans.sliced(events, "t"), ["t", "dur"], {"_end": F.col("t") + F.col("dur")}, by)
        return _counted(x, ["t", "dur"], F.coalesce((F.col("t") - F.col("_end") > gap).cast("int"), F.lit(1)), by, "cluster").drop("_end")
    w = W.partitionBy(*by).orderBy("t", "dur")
    fresh = F.coalesce((F.col("t") - F.lag(F.col("t") + F.col("dur")).over(w) > gap).cast("int"), F.lit(1))
    return events.withColumn("_new", fresh).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def bridged_clusters(events: DataFrame, flow: DataFrame, p: P.ClusterParams, by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """As ``gap_clusters``, and a gap of up to ``p.bridge_gap`` is bridged if a sample of at least
    ``p.bridge_threshold`` lies between the latest end so far and the event.

    Events and samples share one timeline, so the last sample is a running maximum and no join is needed.
    """
    by = list(by)
    marks = flow.filter(F.col("level") >= p.bridge_threshold).select(*by, "t", F.lit(0.0).alias("dur"), F.lit(0).alias("_event"))
    line = events.select(*by, "t", "dur", F.lit(1).alias("_event")).unionByName(marks)
    if _spread(spread, by):
        line = scans.sliced(line, "t")
        line = scans.running(line, ["t"], maxima={"_q": F.when(F.col("_event") == 0, F.col("t"))}, by=by, ties=True).filter("_event = 1")
        line = scans.preceding(line, ["t", "dur"], {"_end": F.col("t") + F.col("dur")}, by)
        line = scans.running(line, ["t", "dur"], maxima={"_far": F.col("_end")}, by=by)
        return _counted(line, ["t", "dur"], _begins(p), by, "cluster").select(*by, "t", "dur", "cluster")
    upto = W.partitionBy(*by).orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    line = line.withColumn("_q", F.max(F.when(F.col("_event") == 0, F.col("t"))).over(upto)).filter("_event = 1")
    w = W.partitionBy(*by).orderBy("t", "dur")
    end = F.lag(F.col("t") + F.col("dur")).over(w)
    line = line.withColumn("_end", end)
    line = line.withColumn("_far", F.max("_end").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return line.withColumn("_new", _begins(p)).withColumn("cluster", F.sum("_new").over(w)).select(*by, "t", "dur", "cluster")


def _begins(p: P.ClusterParams) -> Column:
    """1 where neither the gap nor a bridge joins an event to the one before it."""
    wait = F.col("t") - F.col("_end")
    same = (wait <= p.gap) | ((wait <= p.bridge_gap) & (F.col("_q") >= F.col("_far")))
    return F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)


def flow_segments(flow: DataFrame, p: P.ClusterParams, by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Stretches of flow limitation: entered at ``p.edge_enter``, kept while samples are close and at least ``p.edge_exit``."""
    by = list(by)
    close = lambda before: F.when(F.coalesce((F.col("t") - before <= p.bridge_gap) & (F.col("level") >= p.edge_exit), F.lit(False)), 0).otherwise(1)
    if _spread(spread, by):
        x = scans.preceding(scans.sliced(flow, "t"), ["t", "level"], {"_before": F.col("t")}, by)
        x = _counted(x, ["t", "level"], close(F.col("_before")), by, "_island")
    else:
        w = W.partitionBy(*by).orderBy("t", "level")
        x = flow.withColumn("_new", close(F.lag("t").over(w))).withColumn("_island", F.sum("_new").over(w))
    # from the first sample that enters on, whatever its island is like before
    entered = F.min(F.when(F.col("level") >= p.edge_enter, F.col("t")))
    out = x.groupBy(*by, "_island").agg(entered.alias("seg_start"), F.max("t").alias("seg_end")).filter("seg_start is not null")
    return out.filter(F.col("seg_end") - F.col("seg_start") >= p.edge_min).drop("_island")


def summarize_clusters(assigned: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per cluster with its span, number of events, and densities (events and event-seconds a minute)."""
    out = assigned.groupBy(*by, "cluster").agg(F.min("t").alias("start"), F.max(F.col("t") + F.col("dur")).alias("end"), F.count(F.lit(1)).alias("count"), F.sum("dur").alias("total_sec"))
    return _measured(out)


def _measured(clusters: DataFrame) -> DataFrame:
    span = F.col("end") - F.col("start")
    return clusters.withColumn("span_sec", span).withColumn("density", density(F.col("count"), span)).withColumn("weighted_density", density(F.col("total_sec"), span))


def extend_edges(clusters: DataFrame, segments: DataFrame, gap: float, by: list[str] = ()) -> DataFrame:
    """Clusters grow to the earliest stretch that ends at most ``gap`` before them and the earliest that begins at most
    ``gap`` after. Both sides meet in equal time buckets, so a cluster sees only the stretches near it."""
    by = list(by)
    width = max(gap, 1.0)
    bucket = lambda c: F.floor(c / width).cast("long")
    ends = segments.select(*by, "seg_start", "seg_end", bucket(F.col("seg_end")).alias("_b"))
    starts = segments.select(*by, "seg_start", "seg_end", bucket(F.col("seg_start")).alias("_b"))
    key = [*by, "cluster"]
    near = lambda at, steps: F.explode(F.array(*[bucket(F.col(at)) + s for s in steps]))
    before = clusters.select(*key, "start", near("start", (-1, 0)).alias("_b")).join(ends, [*by, "_b"])
    before = before.filter((F.col("seg_end") <= F.col("start")) & (F.col("start") - F.col("seg_end") <= gap)).groupBy(*key).agg(F.min("seg_start").alias("_from"))
    after = clusters.select(*key, "end", near("end", (0, 1)).alias("_b")).join(starts, [*by, "_b"])
    after = after.filter((F.col("seg_start") >= F.col("end")) & (F.col("seg_start") - F.col("end") <= gap)).groupBy(*key).agg(F.min_by("seg_end", "seg_start").alias("_to"))
    out = clusters.join(before, key, "left").join(after, key, "left")
    out = out.withColumn("start", F.coalesce("_from", "start")).withColumn("end", F.greatest("end", F.coalesce("_to", "end"))).drop("_from", "_to")
    return _measured(out)


#: Points on the line of a subject up to which the best partition is looked for among all; more are put into so many bins.
BINS = 1024


def kmeans_clusters(events: DataFrame, p: P.ClusterParams, by: list[str] = ()) -> DataFrame:
    """Clusters of event starts within each subject, ``p.k`` at most, with the smallest sum of squares, and how they were found.

    On a line clusters are runs, so a subject's distinct starts, counted, are cut by dynamic programming: that is the best of
    all partitions. More than ``BINS`` starts are first put into bins by a sketch of their quantiles; the bins' counts and
    sums are cut that way, and rounds of means by nearest centre, computed by Spark over all starts, settle the borders.
    ``rounds`` is 0 where none were needed.
    """
    by = list(by)
    slim = events.select(*by, "t", "dur").filter(F.col("t").isNotNull())
    starts = slim.groupBy(*by, "t").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    cuts = F.percentile_approx("t", [i / scans.SLICES for i in range(1, scans.SLICES)], 10_000)
    lines = starts.groupBy(*by).agg(F.min("t").alias("_t0"), F.count(F.lit(1)).alias("_m"), F.array_distinct(cuts).alias("_cuts"))
    x = scans.matched(starts, lines, by)
    # places within a slice are dealt evenly, so a slice of a long line has a few bins
    wide = scans.slice_of("_cuts", F.col("t"))
    left, right = F.coalesce(F.get("_cuts", wide - 1), F.col("_t0")), F.get("_cuts", wide)
    part = F.coalesce(F.floor(BINS / scans.SLICES * (F.col("t") - left) / F.when(right > left, right - left)), F.lit(0))
    point = F.when(F.col("_m") <= BINS, F.struct("t", F.lit(0).cast("bigint").alias("i"))).otherwise(F.struct(wide.cast("double").alias("t"), part.alias("i")))
    u = F.col("t") - F.col("_t0")
    bins = x.select(*by, point.alias("_bin"), "t", "_c", "_t0", u.alias("_u")).groupBy(*by, "_bin").agg(
        F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("_u")).alias("s"), F.sum(F.col("_c") * F.col("_u") * F.col("_u")).alias("q"), F.min("t").alias("lo"), F.max("_t0").alias("t0"))

    # at most BINS of them and a few for each subject
    lists = bins.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lo", "n", "s", "q"))).alias("_bins"), F.max("t0").alias("t0")).filter(F.size("_bins") > 0)
    lists = lists.select(*by, "t0", *[F.col("_bins")[c].alias(c) for c in ("lo", "n", "s", "q")])

    def cut(frames):
        for pdf in frames:
            out = []
            for t0, lo, n, total, squares in zip(*(pdf[c] for c in ("t0", "lo", "n", "s", "q")), strict=True):
                at, wcss = kernels.best_cuts(np.asarray(n), np.asarray(total), np.asarray(squares), p.k)
                centres = [float(sum(total[a:b]) / sum(n[a:b]) + t0) for a, b in zip([0, *at], [*at, len(n)], strict=True)]
                out.append(([float(lo[i]) for i in at], centres, wcss))
            yield pd.concat([pdf[by], pd.DataFrame(out, columns=["begin", "centres", "wcss"], index=pdf.index)], axis=1)

    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in by]
    found = lists.mapInPandas(cut, ", ".join([*keys, "begin array<double>, centres array<double>, wcss double"]))
    found = scans.matched(found, lines.select(*by, (F.col("_m") > BINS).alias("_long")), by).withColumns({"rounds": F.lit(0), "settled": ~F.col("_long")})
    found = _settled(found, starts, p, by)
    cluster = F.size(F.filter("begin", lambda b: b <= F.col("t"))).cast("bigint") + 1
    return scans.matched(slim, found.select(*by, "begin", "rounds", "settled", "wcss"), by).withColumn("cluster", cluster).select(*by, "t", "dur", "cluster", "rounds", "settled", "wcss")


def _settled(found: DataFrame, starts: DataFrame, p: P.ClusterParams, by: list[str]) -> DataFrame:
    """Rounds of means over all starts of the long lines in ``found``, until no border moves or ``p.rounds`` are done."""
    spark = found.sparkSession
    if not spark.sparkContext.getCheckpointDir() and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    found = found.checkpoint()
    for turn in range(1, p.rounds + 1):
        open_ = found.filter("not settled")
        if not open_.limit(1).count():
            break
        middle = F.transform(F.sequence(F.lit(1), F.size("centres") - 1), lambda i: (F.get("centres", i - 1) + F.get("centres", i)) / 2)
        borders = open_.select(*by, "centres", F.when(F.size("centres") > 1, middle).otherwise(F.array().cast("array<double>")).alias("_borders"))
        x = scans.matched(starts, borders, by).filter("_borders is not null")
        x = x.withColumn("_k", F.size(F.filter("_borders", lambda b: b <= F.col("t"))))
        d = F.col("t") - F.get("centres", F.col("_k"))
        each = x.groupBy(*by, "_k").agg(F.sum(F.col("_c") * F.col("t")).alias("_s"), F.sum("_c").alias("_n"), F.sum(F.col("_c") * d * d).alias("_q"), F.sum(F.col("_c") * d).alias("_d"), F.min("t").alias("_lo"))
        runs = F.array_sort(F.collect_list(F.struct("_k", F.struct((F.col("_s") / F.col("_n")).alias("c"), "_lo").alias("r"))))
        moved = each.groupBy(*by).agg(runs.alias("_runs"), F.sum(F.col("_q") - F.col("_d") * F.col("_d") / F.col("_n")).alias("_w"))
        step = scans.matched(found, moved, by)
        there = F.col("_runs").isNotNull()
        begin = F.transform(F.slice("_runs", F.lit(2), F.greatest(F.lit(0), F.size("_runs") - 1)), lambda r: r["r"]["_lo"])
        found = step.select(
            *by, F.when(there, begin).otherwise(F.col("begin")).alias("begin"), F.when(there, F.transform("_runs", lambda r: r["r"]["c"])).otherwise(F.col("centres")).alias("centres"),
            F.when(there, F.col("_w")).otherwise(F.col("wcss")).alias("wcss"), F.when(there, turn).otherwise(F.col("rounds")).alias("rounds"),
            F.when(there, begin == F.col("begin")).otherwise(F.col("settled")).alias("settled"),
        ).checkpoint()
    return found


def clusters(events: DataFrame, flow: DataFrame, p: P.ClusterParams = P.ClusterParams(), by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Clusters by the algorithm that ``p`` names: bridged, agglomerative or kmeans."""
    if p.algorithm == "agglomerative":
        out = summarize_clusters(gap_clusters(events, p.gap, by, spread), by)
    elif p.algorithm == "kmeans":
        out = summarize_clusters(kmeans_clusters(events, p, by), by)
    elif p.algorithm == "bridged":
        out = summarize_clusters(bridged_clusters(events, flow, p, by, spread), by)
        out = extend_edges(out.withColumns({"core_start": F.col("start"), "core_end": F.col("end")}), flow_segments(flow, p, by, spread), p.gap, by)
    else:
        raise ValueError(f"unknown algorithm {p.algorithm!r}")
    return out.filter(F.col("density") >= p.min_density) if p.min_density > 0 else out


def finalize(found: DataFrame, p: P.ClusterParams = P.ClusterParams()) -> DataFrame:
    """Clusters with enough events and event time that are not too long, with their severity."""
    kept = found.filter((F.col("count") >= p.min_events) & (F.col("total_sec") >= p.min_total) & (F.col("span_sec") <= p.max_span))
    core = ["core_start", "core_end"]
    grown = (F.col("core_start") - F.col("start")) + (F.col("end") - F.col("core_end")) if set(core) <= set(found.columns) else F.lit(0.0)
    return kept.withColumn("severity", cluster_severity(F.col("total_sec"), F.col("density"), grown))


def valid_date(c: Column | str, kind: str) -> Column:
    """A timestamp out of a timestamp, a date, milliseconds since 1970, or a text; null for what is none."""
    c = F.col(c) if isinstance(c, str) else c
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp")
    if kind == "string":
        return F.coalesce(iso_instant(c), c.try_cast("timestamp"))
    return F.timestamp_millis(c.cast("bigint"))


def normalize_intervals(found: DataFrame, start: str = "start", end: str = "end", events: str | None = None, date: str = "date") -> DataFrame:
    """Clusters or false negatives as they are read back: ``start`` and ``end`` become timestamps, rows without a start drop out,
    a missing end is the start. With an array of ``events`` (structs with a ``date``), undated ones are left out of it, and
    the first and the last stand in for a missing start and end."""
    kinds = dict(found.dtypes)
    first, last = valid_date(start, kinds[start]), valid_date(end, kinds[end])
    out = found
    if events is not None:
        kind = next(f.dataType.simpleString() for f in found.schema[events].dataType.elementType if f.name == date)
        dated = F.filter(F.transform(events, lambda e: e.withField(date, valid_date(e[date], kind))), lambda e: e.isNotNull() & e[date].isNotNull())
        out = out.withColumn(events, dated)
        first = F.coalesce(first, F.get(F.col(events), 0)[date])
        last = F.coalesce(last, F.try_element_at(F.col(events), F.lit(-1))[date])
    return out.withColumns({start: first, end: F.coalesce(last, first)}).filter(F.col(start).isNotNull())


def false_negatives(flow: DataFrame, events: DataFrame, p: P.FalseNegativeParams, by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Stretches of flow limitation of at least ``p.threshold`` with no event from 5 s before to 5 s after."""
    by = list(by)
    x = flow.filter(F.col("level") >= p.threshold)
    apart = lambda before: F.coalesce((F.col("t") - before > p.gap).cast("int"), F.lit(1))
    if _spread(spread, by):
        x = scans.preceding(scans.sliced(x, "t"), ["t", "level"], {"_before": F.col("t")}, by)
        x = _counted(x, ["t", "level"], apart(F.col("_before")), by, "_id")
    else:
        w = W.partitionBy(*by).orderBy("t", "level")
        x = x.withColumn("_new", apart(F.lag("t").over(w))).withColumn("_id", F.sum("_new").over(w))
    runs = x.groupBy(*by, "_id").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max("level").alias("peak"))
    span = F.col("end") - F.col("start")
    runs = runs.filter((span >= p.min_span) & (span <= p.max_span) & (F.col("peak") >= p.peak)).withColumn("span_sec", span)
    return without_events(runs, events, P.EVENT_WINDOW_SEC, by).drop("_id")


def without_events(runs: DataFrame, events: DataFrame, margin: float, by: list[str] = (), width: float = 600.0) -> DataFrame:
    """Intervals ``start, end`` with no event within ``margin`` of them; both sides meet in time buckets."""
    by = list(by)
    runs = runs.withColumn("_b", F.explode(F.sequence(F.floor((F.col("start") - margin) / width), F.floor((F.col("end") + margin) / width))))
    points = events.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("t").alias("_t"), F.floor(F.col("t") / width).alias("_pb"))
    same = F.col("_b") == F.col("_pb")
    for b in by:
        same &= F.col(b) == F.col(f"_{b}")
    inside = F.col("_t").between(F.col("start") - margin, F.col("end") + margin)
    hit = runs.join(points, same & inside, "left_semi").select(*by, "start").distinct()
    return runs.drop("_b").distinct().join(hit, [*by, "start"], "left_anti")


def within(intervals: DataFrame, points: DataFrame, by: list[str] = (), margin: float = 0.0, width: float = 3600.0) -> DataFrame:
    """Every (interval, point) with ``start - margin <= t <= end + margin``, by equal time buckets."""
    by = list(by)
    spread = intervals.withColumn("_b", F.explode(F.sequence(F.floor((F.col("start") - margin) / width), F.floor((F.col("end") + margin) / width))))
    bucketed = points.withColumn("_b", F.floor(F.col("t") / width))
    met = spread.join(bucketed, [*by, "_b"]).drop("_b")
    return met.filter((F.col("t") >= F.col("start") - margin) & (F.col("t") <= F.col("end") + margin))


def range_stats(intervals: DataFrame, points: DataFrame, key: list[str], value: str, by: list[str] = (), margin: float = 0.0) -> DataFrame:
    """Least and largest value of the points inside each interval."""
    return within(intervals, points, by, margin).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def bad_nights(nights: DataFrame, day: str, ahi: str, found: DataFrame, least: float, most: int | None = 10) -> DataFrame:
    """The first ``most`` nights (all, if None), in date order, at or above ``least``, with the largest severity of their
    clusters."""
    worst = found.groupBy(F.to_date(F.timestamp_seconds("start")).alias("_day")).agg(F.max("severity").alias("worst"))
    out = nights.filter(finite(ahi) >= least).select(F.to_date(day).alias("day"), finite(ahi).alias("ahi"))
    out = out.join(worst, out["day"] == worst["_day"], "left").select("day", "ahi", "worst")
    return out if most is None else out.orderBy("day").limit(most)
