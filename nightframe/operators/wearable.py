"""Wearable nights: sessions folded into nights, the clock offset of each night, samples brought to nights, nightly
measures behind their coverage gates, and intraday series.

Windows are wall-clock times (``timestamp_ntz``); oximetry comes as instants. ``local = utc + offset``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nightframe.functions.exprs import finite, ratio, wall_minutes

# Coverage gates and special readings.
SPO2_SENTINEL, SPO2_MINUTES, HR_SAMPLES, HRV_COVERAGE, SNORE_EPOCHS = 50.0, 120, 300, 0.5, 120
# How offsets are searched, in minutes, and what is believed.
SEARCH, STEP, LEAST_SAMPLES, LEAST_SHARE, CARRY_NIGHTS, DISAGREE, DEFAULT_OFFSET = 840, 15, 30, 0.5, 2, 15, -480

STAGES = ("deep", "light", "rem", "wake")


def dedup_sessions(sessions: DataFrame) -> DataFrame:
    """One row per ``log_id`` (the first file by name wins), main sleeps only, with all files that hold it and whether
    their windows disagree."""
    files = sessions.filter(F.coalesce("main_sleep", F.lit(False)))
    w = W.partitionBy("log_id")
    ranked = files.withColumn("_k", F.row_number().over(w.orderBy("file", "start_local", "end_local")))
    ranked = ranked.withColumn("source_files", F.array_sort(F.collect_set("file").over(w)))
    differ = (F.min("start_local").over(w) != F.max("start_local").over(w)) | (F.min("end_local").over(w) != F.max("end_local").over(w))
    return ranked.withColumn("window_mismatch", differ).filter("_k = 1").drop("_k", "file")


def sleep_architecture(sessions: DataFrame) -> DataFrame:
    """Minutes awake after sleep began, and stage shares; classic sessions have no stages."""
    classic = F.coalesce(F.col("type") == "classic", F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    waso = F.when(classic, zero("restless_min") + zero("awake_stage_min")).when(
        F.col("awake_min").isNotNull() & F.col("onset_latency_min").isNotNull(),
        F.greatest(F.lit(0.0), F.col("awake_min") - F.col("onset_latency_min") - zero("after_wakeup_min")),
    )
    out = sessions.withColumn("waso_min", waso)
    for s in STAGES:
        out = out.withColumn(f"{s}_min", F.when(~classic, F.col(f"{s}_min")))
    return with_shares(out.withColumn("is_classic", classic))


def with_shares(df: DataFrame) -> DataFrame:
    for s in STAGES[:3]:
        df = df.withColumn(f"{s}_pct", F.when(F.col("asleep_min") > 0, 100 * F.col(f"{s}_min") / F.col("asleep_min")))
    return df


def fold_nights(sessions: DataFrame) -> DataFrame:
    """Sessions of one date become one night: the union of their windows, summed minutes (null if none has any)."""
    order = F.struct("start_local", "log_id")
    total = [F.sum(c).alias(c) for c in ("time_in_bed_min", "asleep_min", "awake_min", "waso_min", *[f"{s}_min" for s in STAGES])]
    n = F.count(F.lit(1))
    out = sessions.groupBy(F.col("date_of_sleep").alias("night")).agg(
        F.min_by("log_id", order).alias("log_id"),
        F.min_by("type", order).alias("sleep_type"),
        F.min("start_local").alias("start_local"),
        F.max("end_local").alias("end_local"),
        F.min_by("onset_latency_min", order).alias("onset_latency_min"),
        ratio(F.sum(F.col("efficiency_pct") * F.col("time_in_bed_min")), F.sum(F.when(F.col("efficiency_pct").isNotNull(), F.col("time_in_bed_min")))).alias("efficiency_pct"),
        *total,
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_files")))).alias("source_files"),
        F.array_compact(F.array(F.when(n > 1, "split-sleep"), F.when(F.max("window_mismatch"), "window-mismatch"), F.when(F.max("is_classic"), "classic"))).alias("flags"),
    )
    return with_shares(out)


# --- clock offsets -----------------------------------------------------------------------------------------------


def samples_near(nights: DataFrame, samples: DataFrame, key: str = "night", pad_minutes: float = SEARCH, by: list[str] = ()) -> DataFrame:
    """Samples (``utc_min``) that could lie in a night's window (``start_min``, ``end_min``) under some offset, met by
    half-day buckets; those of the same wearer where ``by`` names columns that tell wearers apart."""
    width, by = 720.0, list(by)
    spread = nights.select(*by, key, "start_min", "end_min", F.explode(F.sequence(F.floor((F.col("start_min") - pad_minutes) / width), F.floor((F.col("end_min") + pad_minutes) / width))).alias("_b"))
    met = spread.join(samples.withColumn("_b", F.floor(F.col("utc_min") / width)), [*by, "_b"]).drop("_b")
    return met.filter((F.col("utc_min") >= F.col("start_min") - pad_minutes) & (F.col("utc_min") < F.col("end_min") + pad_minutes))


def offset_scores(near: DataFrame, key: str = "night", by: list[str] = ()) -> DataFrame:
    """For each night and each offset of the search, the share of the night's samples that falls into its window.

    A sample is inside for a run of consecutive offsets, so it adds one and takes one away at the ends of its run, and
    running sums give the counts of all offsets: two short rows for each sample instead of one for each offset.
    """
    first = F.greatest(F.lit(-SEARCH), F.ceil((F.col("start_min") - F.col("utc_min")) / STEP) * STEP)
    last = F.least(F.lit(SEARCH), (F.ceil((F.col("end_min") - F.col("utc_min")) / STEP) - 1) * STEP)
    ends = F.array(F.struct(first.cast("int").alias("o"), F.lit(1).alias("d")), F.struct((last + STEP).cast("int").alias("o"), F.lit(-1).alias("d")))
    marks = near.filter(first <= last).select(*by, key, F.explode(ends).alias("m")).groupBy(*by, key, F.col("m.o").alias("offset")).agg(F.sum("m.d").alias("_d"))
    totals = near.groupBy(*by, key).agg(F.count(F.lit(1)).alias("total"))
    grid = totals.select(*by, key, "total", F.explode(F.sequence(F.lit(-SEARCH), F.lit(SEARCH), F.lit(STEP))).alias("offset"))
    counted = grid.join(marks, [*by, key, "offset"], "left").withColumn("inside", F.sum(F.coalesce("_d", F.lit(0))).over(W.partitionBy(*by, key).orderBy("offset")))
    return counted.select(*by, key, "offset", "inside", "total", (F.col("inside") / F.col("total")).alias("share"))


def infer_offsets(near: DataFrame, key: str = "night", by: list[str] = ()) -> DataFrame:
    """The offset of the largest share; of equals the one nearest to the last believed offset before (0 before any), then the
    smallest in size, then the more negative. Too few samples or too small a share are not believed; ``unstable`` says that
    the commonest start-to-sample distance tells otherwise.

    What one night believes decides ties of the next, so the nights of a wearer (``by`` names the columns that tell wearers
    apart), one short row for each day, are walked in order; everything before that is grouped by night.
    """
    by = list(by)
    scores = offset_scores(near, key, by)
    most = scores.groupBy(*by, key).agg(F.max("inside").alias("_top"))
    enough = F.col("total") >= LEAST_SAMPLES
    best = scores.join(most, [*by, key]).filter("inside = _top").groupBy(*by, key).agg(F.sort_array(F.collect_list("offset")).alias("_ties"), F.max("share").alias("share"), F.max("total").alias("total"))
    best = best.withColumn("confident", enough & (F.col("share") >= LEAST_SHARE))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, chosen = pdf.sort_values(key), None, []
        for ties, sure in zip(pdf["_ties"], pdf["confident"], strict=True):
            one = None if ties is None else min((abs(int(o) - (last or 0)), abs(int(o)), int(o)) for o in ties)[2]
            chosen.append(one)
            last = one if sure else last
        return pdf[[*by, key]].assign(offset=pd.array(chosen, dtype="Int32"))

    slim = best.select(*by, key, F.when(enough, F.col("_ties")).alias("_ties"), "confident")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in (*by, key)]
    offsets = slim.groupBy(*(by or [F.lit("").alias("_one")])).applyInPandas(walk, ", ".join([*kinds, "offset int"]))
    modal = near.groupBy(*by, key, (F.floor((F.col("start_min") - F.col("utc_min")) / STEP + 0.5) * STEP).alias("_m")).agg(F.count(F.lit(1)).alias("_c"))
    modal = modal.groupBy(*by, key).agg(F.max_by("_m", F.struct("_c", -F.col("_m"))).alias("modal"))
    out = best.join(offsets, [*by, key]).join(modal, [*by, key])
    return out.select(
        *by, key, "offset", F.when(enough, F.col("share")).otherwise(0.0).alias("share"), "total", "confident",
        (enough & (F.abs(F.col("modal") - F.col("offset")) > STEP)).alias("unstable"),
    )


def resolve_offsets(nights: DataFrame, by: list[str] = ()) -> DataFrame:
    """The offset to use: inferred, else the export's hint unless it is the placeholder 0, else the last inferred one of
    up to two nights before, else the default. ``nights`` has ``night, offset, confident, hint``."""
    w = W.partitionBy(*by).orderBy("night").rowsBetween(W.unboundedPreceding, -1)
    good = F.col("confident") & F.col("offset").isNotNull()
    x = nights.withColumn("_last", F.last(F.when(good, F.struct("night", "offset")), ignorenulls=True).over(w))
    carried = F.when(F.datediff("night", F.col("_last")["night"]) <= CARRY_NIGHTS, F.col("_last")["offset"])
    hint = F.when(F.col("hint") != 0, F.col("hint"))
    chosen = F.when(good, F.col("offset"))
    source = F.when(good, "inferred").when(hint.isNotNull(), "userSleeps-hint").when(carried.isNotNull(), "carry-forward").otherwise("default-fallback")
    gap = F.when(good & hint.isNotNull(), F.abs(hint - F.col("offset")))
    return x.select(
        *by, "night", F.coalesce(chosen, hint, carried, F.lit(DEFAULT_OFFSET)).cast("int").alias("utc_offset_min"), source.alias("window_source"),
        F.when(gap >= DISAGREE, gap).cast("int").alias("offset_disagreement_min"),
    )


# --- nightly measures --------------------------------------------------------------------------------------------


def assign_local(nights: DataFrame, samples: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Samples at wall-clock minutes ``local_min`` inside a night's half-open window, with the night; those of the same wearer
    where ``by`` tells wearers apart."""
    width, by = 720.0, list(by)
    spread = nights.select(*by, "night", "start_min", "end_min", F.explode(F.sequence(F.floor(F.col("start_min") / width), F.floor(F.col("end_min") / width))).alias("_b"))
    met = samples.select(*by, "local_min", *columns).withColumn("_b", F.floor(F.col("local_min") / width)).join(spread, [*by, "_b"])
    return met.filter((F.col("local_min") >= F.col("start_min")) & (F.col("local_min") < F.col("end_min"))).select(*by, "night", "local_min", *columns)


def _share(condition: Column, n: Column) -> Column:
    return 100 * ratio(F.count(F.when(condition, 1)), n)


def gated(df: DataFrame, name: str, enough: Column, fields: list[str], counts: list[str]) -> DataFrame:
    """One struct that is null where coverage falls short, and whether it did: absent and insufficient stay apart."""
    whole = F.struct(*[F.col(f) for f in fields])
    return df.select("night", F.when(enough, whole).alias(name), (~enough).alias(f"{name}_insufficient"), *counts)


def spo2_nightly(samples: DataFrame, value: str = "value") -> DataFrame:
    """The sentinel is dropped, and nothing else; minutes under 70 only raise a flag."""
    v = finite(value)
    real = F.when(v != SPO2_SENTINEL, v)
    n = F.count(real)
    out = samples.groupBy("night").agg(
        F.avg(real).alias("mean_pct"), F.percentile(real, F.lit(0.5)).alias("median_pct"), F.min(real).alias("min_pct"), F.percentile(real, F.lit(0.05)).alias("p5_pct"),
        _share(real < 90, n).alias("pct_time_below_90"), _share(real < 88, n).alias("pct_time_below_88"), n.alias("valid_minutes"),
        F.count(F.when(v == SPO2_SENTINEL, 1)).alias("sentinel_minutes_removed"), F.count(F.when(real < 70, 1)).alias("sub_seventy_minutes"),
    )
    return gated(out, "spo2", F.col("valid_minutes") >= SPO2_MINUTES, [c for c in out.columns if c != "night"], ["valid_minutes", "sentinel_minutes_removed", "sub_seventy_minutes"])


def hr_nightly(samples: DataFrame, bpm: str = "bpm", confidence: str = "confidence") -> DataFrame:
    v = F.when(F.col(confidence).isNull() | (F.col(confidence) > 0), finite(bpm))
    out = samples.groupBy("night").agg(F.min(v).alias("sleeping_min"), F.avg(v).alias("sleeping_avg"), F.max(v).alias("sleeping_max"), F.percentile(v, F.lit(0.1)).alias("sleeping_p10"), F.count(v).alias("sample_count"))
    return gated(out, "hr", F.col("sample_count") >= HR_SAMPLES, [c for c in out.columns if c != "night"], ["sample_count"])


def hrv_nightly(samples: DataFrame) -> DataFrame:
    out = samples.groupBy("night").agg(F.avg(finite("rmssd")).alias("rmssd_ms"), F.avg(finite("coverage")).alias("coverage_pct"), F.count(F.lit(1)).alias("hrv_windows"))
    return gated(out, "hrv", F.coalesce(F.col("coverage_pct") >= HRV_COVERAGE, F.lit(False)), ["rmssd_ms", "coverage_pct"], ["hrv_windows"])


def snore_nightly(samples: DataFrame, nights: DataFrame) -> DataFrame:
    """Half a minute for each epoch with a label, as a share of the time asleep."""
    labelled = F.col("snore_label").isNotNull() & ~F.lower(F.trim("snore_label")).isin("", "none", "0", "no_snore")
    out = samples.groupBy("night").agg((0.5 * F.count(F.when(labelled, 1))).alias("snore_minutes"), F.avg(finite("mean_dba")).alias("mean_dba"), F.max(finite("max_dba")).alias("max_dba"), F.count(F.lit(1)).alias("snore_epochs"))
    out = out.join(nights.select("night", "asleep_min"), "night", "left").withColumn("snore_pct_of_sleep", F.when(F.col("asleep_min") > 0, 100 * F.col("snore_minutes") / F.col("asleep_min")))
    return gated(out, "snore", F.col("snore_epochs") >= SNORE_EPOCHS, ["snore_minutes", "snore_pct_of_sleep", "mean_dba", "max_dba"], ["snore_epochs"])


def downsample(points: DataFrame, value: str, cadence_sec: int, by: list[str]) -> DataFrame:
    """A dense array of rounded bucket means from the first sample on, null where there is none. ``sec`` is the time. The
    samples of a bucket are added in the order of time (then value), as a mean may lie at a half but for what is lost in adding."""
    first = points.groupBy(*by).agg(F.min("sec").alias("t0"))
    x = points.join(first, by).withColumn("_k", F.floor((F.col("sec") - F.col("t0")) / cadence_sec).cast("int"))
    samples = F.array_sort(F.collect_list(F.when(finite(value).isNotNull(), F.struct("sec", finite(value).alias("v")))))
    mean = F.aggregate(samples, F.lit(0.0), lambda total, s: total + s["v"]) / F.nullif(F.size(samples), F.lit(0))
    means = x.groupBy(*by, "t0", "_k").agg(F.floor(mean + 0.5).cast("smallint").alias("_v"))
    packed = means.groupBy(*by, "t0").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"), F.max("_k").alias("_last"))
    values = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.try_element_at("_m", i))
    return packed.select(*by, F.lit(cadence_sec).alias("cadence_sec"), "t0", values.alias("values"))


def expand_series(series: DataFrame, by: list[str]) -> DataFrame:
    """A stored series as points; the stored filler 0 and null are gaps."""
    long = series.select(*by, "t0", "cadence_sec", F.posexplode("values").alias("_i", "v"))
    return long.select(*by, (F.col("t0") + F.col("_i") * F.col("cadence_sec")).alias("sec"), F.when(F.col("v") != 0, F.col("v")).alias("value"))


def stage_shares(nights: DataFrame) -> DataFrame:
    """Hypnogram shares over the staged minutes."""
    total = sum((F.coalesce(F.col(f"{s}_min"), F.lit(0.0)) for s in STAGES), F.lit(0.0))
    return nights.select("night", *[(100 * ratio(F.col(f"{s}_min"), F.when(total > 0, total))).alias(f"{s}_share") for s in STAGES])


def assemble(nights: DataFrame, daily: dict[str, DataFrame], measures: list[DataFrame], names: list[str]) -> DataFrame:
    """Nights with their daily sources (by date) and gated measures, and the names of those that fell short."""
    out = nights
    for source in daily.values():
        out = out.join(source, "night", "left")
    for m in measures:
        out = out.join(m, "night", "left")
    short = [F.when(F.col(f"{n}_insufficient"), n) for n in names]
    flag = F.when(F.coalesce(F.col("sub_seventy_minutes"), F.lit(0)) > 0, F.array(F.lit("spo2-sub-70"))).otherwise(F.array().cast("array<string>")) if "spo2" in names else F.array().cast("array<string>")
    out = out.withColumn("insufficient", F.array_compact(F.array(*short)) if short else F.array().cast("array<string>"))
    return out.withColumn("flags", F.concat("flags", flag)).drop(*[f"{n}_insufficient" for n in names])


# --- alignment with the therapy summary --------------------------------------------------------------------------


def overlap_hours(usage: Column, asleep_min: Column, window_min: Column) -> Column:
    worn = F.coalesce(asleep_min / 60, F.when(window_min > 0, window_min / 60))
    return F.greatest(F.lit(0.0), F.coalesce(F.least(usage, worn), worn, usage, F.lit(0.0)))


def align(summary: DataFrame, nights: DataFrame, least_hours: float = 4.0, mismatch_hours: float = 2.0) -> DataFrame:
    """Therapy rows with wearable nights, one to one. ``summary`` has ``row_id, day, usage_hours``; ``nights`` has
    ``night, asleep_min, window_min``.

    Equal dates match first. What is left matches a neighbouring date with at least ``least_hours`` of overlap: each row
    asks for its best night (the earlier of equals), each night takes the best of the rows that ask, and rows that were
    refused ask once more for what is still free.
    """
    spare = W.partitionBy("day").orderBy("row_id")
    rows = summary.withColumn("_k", F.row_number().over(spare))
    n = nights.select("night", "asleep_min", "window_min")
    exact = rows.filter("_k = 1").join(n, F.col("day") == F.col("night")).withColumn("match_type", F.lit("exact"))
    ov = overlap_hours(F.col("usage_hours"), F.col("asleep_min"), F.col("window_min"))
    keep = ["row_id", "day", "usage_hours", "night", "asleep_min", "match_type"]
    done = exact.withColumn("overlap_hours", ov).select(*keep, "overlap_hours")
    for _ in range(2):
        free_rows = rows.drop("_k").join(done.select("row_id"), "row_id", "left_anti")
        free_nights = n.join(done.select("night"), "night", "left_anti")
        asked = free_rows.withColumn("_shift", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("night", F.date_add("day", F.col("_shift"))).join(free_nights, "night")
        asked = asked.withColumn("overlap_hours", ov).filter(F.col("overlap_hours") >= least_hours)
        asked = asked.withColumn("_a", F.row_number().over(W.partitionBy("row_id").orderBy(F.desc("overlap_hours"), "_shift"))).filter("_a = 1")
        won = asked.withColumn("_b", F.row_number().over(W.partitionBy("night").orderBy(F.desc("overlap_hours"), "day", "row_id"))).filter("_b = 1")
        won = won.withColumn("match_type", F.when(F.col("_shift") == 1, "shifted+1").otherwise("shifted-1"))
        done = done.unionByName(won.select(*keep, "overlap_hours"))
    differs = F.abs(F.col("usage_hours") - F.col("asleep_min") / 60) > mismatch_hours
    return done.withColumn("duration_mismatch", F.coalesce(differs, F.lit(False))).drop("asleep_min")


def alignment_statistics(summary: DataFrame, nights: DataFrame, aligned: DataFrame) -> DataFrame:
    totals = summary.agg(F.count(F.lit(1)).alias("summary_total")).join(F.broadcast(nights.agg(F.count(F.lit(1)).alias("wearable_total"))))
    kinds = ("exact", "shifted-1", "shifted+1")
    found = aligned.agg(F.count(F.lit(1)).alias("aligned"), *[F.count(F.when(F.col("match_type") == k, 1)).alias(k.replace("-1", "_before").replace("+1", "_after")) for k in kinds])
    return totals.join(F.broadcast(found)).withColumn("match_rate", F.col("aligned") / F.greatest(F.col("summary_total"), F.lit(1)))


def offset_provenance(nights: DataFrame, source: str = "window_source") -> DataFrame:
    """Shares of nights by where their offset came from."""
    names = {"inferred": "inferred_pct", "userSleeps-hint": "hint_pct", "carry-forward": "carry_forward_pct", "default-fallback": "default_fallback_pct"}
    return nights.agg(F.count(F.lit(1)).alias("n"), *[ratio(F.count(F.when(F.col(source) == k, 1)), F.count(F.lit(1))).alias(v) for k, v in names.items()])


def with_minutes(nights: DataFrame) -> DataFrame:
    start, end = wall_minutes("start_local"), wall_minutes("end_local")
    return nights.withColumn("start_min", start).withColumn("end_min", end).withColumn("window_min", end - start)


