"""From an export folder to nights and intraday series, as one declared plan over all files of each metric."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.operators import wearable as N
from nightframe.sources import parsers as R
from nightframe.sources import store
from nightframe.sources.export_tree import ExportFile, enumerate_export

#: Seconds between the points of the stored series.
CADENCE = {"hr": 60, "spo2": 60, "hrv": 300, "snore": 30}


@dataclass
class Ingested:
    nights: DataFrame
    intraday: DataFrame
    malformed: DataFrame
    files: list[ExportFile]


def ingest(spark: SparkSession, root: str, opt_in: bool = False, manifest: DataFrame | None = None, since: str | None = None) -> Ingested:
    """Nights with everything the export has for them. With a ``manifest`` (relative, size) known series files are not
    read again; with ``since`` only later nights come out."""
    files = enumerate_export(spark, root, opt_in)
    if manifest is not None:
        # the listing is metadata on the driver already; only files of series are worth skipping
        known = {(r["relative"], r["size"]) for r in manifest.select("relative", "size").collect()}
        files = [f for f in files if f.kind.phase == "windows" or (f.relative, f.size) not in known]
    paths: dict[str, list[str]] = {}
    for f in files:
        paths.setdefault(f.kind.metric, []).append(f.path)
    rows: dict[str, DataFrame] = {m: R.PARSERS[m](spark, p) for m, p in paths.items()}
    bad = None
    for metric, df in rows.items():
        counted = R.malformed(df).withColumn("metric", F.lit(metric))
        bad = counted if bad is None else bad.unionByName(counted)
    if bad is None:
        bad = spark.createDataFrame([], "file string, malformed bigint, rows bigint, metric string")

    if "sleep" not in rows:
        sessions = spark.createDataFrame([], "log_id bigint, date_of_sleep date, start_local timestamp_ntz, end_local timestamp_ntz, type string, main_sleep boolean, time_in_bed_min double, asleep_min double, awake_min double, onset_latency_min double, after_wakeup_min double, efficiency_pct double, deep_min double, light_min double, rem_min double, wake_min double, restless_min double, awake_stage_min double, file string")
    else:
        sessions = R.kept(rows["sleep"])
    nights = N.with_minutes(N.fold_nights(N.sleep_architecture(N.dedup_sessions(sessions))))
    nights = store.since(nights, since)
    if "sleep_score" in rows:
        scores = store.last_writer(R.kept(rows["sleep_score"]), ["log_id"], ["file"])
        nights = nights.join(scores.select("log_id", "score", "composition_score", "revitalization_score"), "log_id", "left")

    daily: dict[str, DataFrame] = {}
    for metric, columns in {
        "resting_hr": ["resting_bpm"], "hr_zones": [f"zone{i}_min" for i in range(4)], "readiness": ["readiness_score", "readiness_state", "activity_sub", "sleep_sub", "hrv_sub"],
        "stress": ["stress_score", "sleep_points", "responsiveness_points", "exertion_points", "stress_status"], "hrv_summary": ["daily_rmssd", "nremhr_bpm", "entropy"],
        "resp_rate_daily": ["rr_nightly"], "resp_rate_stage": ["rr_deep", "rr_light", "rr_rem", "rr_full", "rr_signal_to_noise"], "temperature": ["skin_temperature"],
        "spo2_daily": ["spo2_average", "spo2_lower", "spo2_upper"],
    }.items():
        if metric in rows:
            daily[metric] = store.last_writer(R.kept(rows[metric]), ["night"], ["file"]).select("night", *columns)
    for metric, name in {"azm": "azm_minutes", "steps": "steps", "active_minutes": "active_minutes"}.items():
        if metric in rows:
            daily[metric] = R.summed(rows[metric], name)

    hints = R.first_hint(rows["user_sleeps"]) if "user_sleeps" in rows else spark.createDataFrame([], "night date, hint int")
    window = nights.select("night", "start_min", "end_min")
    if "spo2_minute" in rows:
        samples = R.kept(rows["spo2_minute"]).select("utc_min", "value")
        near = N.samples_near(window, samples)
        inferred = N.infer_offsets(near)
    else:
        samples, near = None, None
        inferred = spark.createDataFrame([], "night date, offset int, share double, total bigint, confident boolean, unstable boolean")
    known = nights.select("night").join(inferred, "night", "left").join(hints, "night", "left").withColumn("confident", F.coalesce("confident", F.lit(False)))
    offsets = N.resolve_offsets(known.select("night", "offset", "confident", "hint"))
    nights = nights.join(offsets, "night", "left").join(inferred.select("night", F.col("unstable").alias("offset_unstable")), "night", "left")
    start_utc = lambda c: F.timestamp_seconds((F.col(c) - F.col("utc_offset_min")) * 60)
    nights = nights.withColumns({"start_utc": start_utc("start_min"), "end_utc": start_utc("end_min")})

    measures, names, points = [], [], []
    if near is not None:
        local = near.join(offsets.select("night", "utc_offset_min"), "night").withColumn("local_min", F.col("utc_min") + F.col("utc_offset_min"))
        local = local.filter((F.col("local_min") >= F.col("start_min")) & (F.col("local_min") < F.col("end_min")))
        measures.append(N.spo2_nightly(local))
        names.append("spo2")
        points.append(local.filter(F.col("value") != N.SPO2_SENTINEL).select("night", F.lit("spo2").alias("metric"), (F.col("local_min") * 60).alias("sec"), "value"))
    for metric, short, columns, value in (("heart_rate", "hr", ["bpm", "confidence"], "bpm"), ("hrv_details", "hrv", ["rmssd", "coverage"], "rmssd"), ("snore", "snore", ["mean_dba", "max_dba", "snore_label"], "mean_dba")):
        if metric in rows:
            inside = N.assign_local(window, R.kept(rows[metric]), columns)
            make = {"hr": N.hr_nightly, "hrv": N.hrv_nightly, "snore": lambda s: N.snore_nightly(s, nights)}[short]
            measures.append(make(inside))
            names.append(short)
            points.append(inside.select("night", F.lit(short).alias("metric"), (F.col("local_min") * 60).alias("sec"), F.col(value).cast("double").alias("value")))
    full = N.assemble(nights, daily, measures, names)
    if points:
        series = None
        for p in points:
            name = names[points.index(p)]
            one = N.downsample(p, "value", CADENCE[name], ["night", "metric"])
            series = one if series is None else series.unionByName(one)
    else:
        series = spark.createDataFrame([], "night date, metric string, cadence_sec int, t0 double, values array<smallint>")
    return Ingested(full, series, bad, files)


def manifest_of(spark: SparkSession, files: list[ExportFile]) -> DataFrame:
    return spark.createDataFrame([(f.relative, f.size, f.kind.metric) for f in files], "relative string, size bigint, metric string")
