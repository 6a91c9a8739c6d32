"""Readers of the export's files. None of them fails on bad content: rows that lack what they need are left out, and
``malformed`` counts them by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.functions import exprs as X
from nightframe.sources import files


def _file() -> Column:
    return F.col("_metadata.file_path").alias("file")


def _csv(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Text columns by name, missing ones null, with the file each row is from."""
    raw = files.read_csv(spark, paths)
    have = set(raw.columns)
    return raw.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast("string").alias(c) for c in columns], F.col("_file").alias("file"))


def _json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Arrays of objects, one row each; a file that is no JSON gives one row with only ``_bad``."""
    reader = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad")
    return reader.json(paths, multiLine=True, mode="PERMISSIVE").select("*", _file())


def _num(c: str) -> Column:
    return X.number(c)


def split_rows(rows: DataFrame, good: Column) -> DataFrame:
    """Adds ``ok``; rows where it is false are malformed."""
    return rows.withColumn("ok", F.coalesce(good, F.lit(False)))


def malformed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.count(F.when(~F.col("ok"), 1)).alias("malformed"), F.count(F.lit(1)).alias("rows"))


def kept(rows: DataFrame) -> DataFrame:
    return rows.filter("ok").drop("ok")


def sleep(spark: SparkSession, paths: list[str]) -> DataFrame:
    minutes = "struct<minutes:double>"
    stages = "deep light rem wake restless awake".split()
    raw = _json(
        spark, paths,
        "logId bigint, dateOfSleep string, startTime string, endTime string, type string, mainSleep boolean, timeInBed double, minutesAsleep double, minutesAwake double, "
        f"minutesToFallAsleep double, minutesAfterWakeup double, efficiency double, levels struct<summary:struct<{', '.join(f'{s}:{minutes}' for s in stages)}>>",
    )
    s = lambda name: F.col(f"levels.summary.{name}.minutes")
    out = raw.select(
        F.col("logId").alias("log_id"), F.try_to_date(F.substring("dateOfSleep", 1, 10)).alias("date_of_sleep"), X.iso_wall("startTime").alias("start_local"), X.iso_wall("endTime").alias("end_local"),
        "type", F.col("mainSleep").alias("main_sleep"), F.col("timeInBed").alias("time_in_bed_min"), F.col("minutesAsleep").alias("asleep_min"), F.col("minutesAwake").alias("awake_min"),
        F.col("minutesToFallAsleep").alias("onset_latency_min"), F.col("minutesAfterWakeup").alias("after_wakeup_min"), F.col("efficiency").alias("efficiency_pct"),
        *[s(x).alias(f"{x}_min") for x in ("deep", "light", "rem", "wake", "restless")], s("awake").alias("awake_stage_min"), "file",
    )
    return split_rows(out, F.col("log_id").isNotNull() & F.col("date_of_sleep").isNotNull() & F.col("start_local").isNotNull() & F.col("end_local").isNotNull())


def sleep_score(spark: SparkSession, paths: list[str]) -> DataFrame:
    names = {"overall_score": "score", "composition_score": "composition_score", "revitalization_score": "revitalization_score", "duration_score": "duration_score", "deep_sleep_in_minutes": "deep_min", "resting_heart_rate": "resting_bpm", "restlessness": "restlessness"}
    raw = _csv(spark, paths, ["sleep_log_entry_id", *names])
    out = raw.select(F.col("sleep_log_entry_id").try_cast("bigint").alias("log_id"), *[_num(c).alias(n) for c, n in names.items()], "file")
    return split_rows(out, F.col("log_id").isNotNull())


def user_sleeps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Offset hints by night: the date of the start in its own offset; the first row of a date wins."""
    raw = _csv(spark, paths, ["sleep_start", "start_utc_offset"])
    offset = X.offset_minutes("start_utc_offset")
    start = F.coalesce(X.iso_instant("sleep_start"), X.iso_wall("sleep_start").cast("timestamp"))
    out = raw.select(F.to_date(start + F.make_dt_interval(mins=offset)).alias("night"), offset.alias("hint"), start.alias("_start"), "file")
    return split_rows(out, F.col("night").isNotNull() & F.col("hint").isNotNull())


def first_hint(rows: DataFrame) -> DataFrame:
    return kept(rows).groupBy("night").agg(F.min_by("hint", F.struct("file", "_start")).alias("hint"))


def resting_hr(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = _json(spark, paths, "dateTime string, value struct<date:string, value:double, error:double>")
    out = raw.select(F.to_date(X.us_timestamp("value.date")).alias("night"), F.when(F.col("value.value") > 0, F.col("value.value")).alias("resting_bpm"), "file")
    return split_rows(out, F.col("night").isNotNull() & F.col("resting_bpm").isNotNull())


def hr_zones(spark: SparkSession, paths: list[str]) -> DataFrame:
    zones = ("BELOW_DEFAULT_ZONE_1", "IN_DEFAULT_ZONE_1", "IN_DEFAULT_ZONE_2", "IN_DEFAULT_ZONE_3")
    raw = _json(spark, paths, f"dateTime string, value struct<valuesInZones:struct<{', '.join(f'{z}:double' for z in zones)}>>")
    day = F.to_date(F.coalesce(X.us_timestamp("dateTime"), X.iso_wall("dateTime")))
    out = raw.select(day.alias("night"), *[F.col(f"value.valuesInZones.{z}").alias(f"zone{i}_min") for i, z in enumerate(zones)], "file")
    return split_rows(out, F.col("night").isNotNull())


def _daily(spark: SparkSession, paths: list[str], day: str, names: dict[str, str], texts: dict[str, str] | None = None) -> DataFrame:
    texts = texts or {}
    raw = _csv(spark, paths, [day, *names, *texts])
    out = raw.select(F.to_date(X.iso_wall(day)).alias("night"), *[_num(f"`{c}`").alias(n) for c, n in names.items()], *[F.col(c).alias(n) for c, n in texts.items()], "file")
    return split_rows(out, F.col("night").isNotNull())


def readiness(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _daily(spark, paths, "date", {"readiness_score_value": "readiness_score", "activity_subcomponent": "activity_sub", "sleep_subcomponent": "sleep_sub", "hrv_subcomponent": "hrv_sub"}, {"readiness_state": "readiness_state"})


def stress(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Days whose calculation failed are left out and are not malformed."""
    out = _daily(spark, paths, "DATE", {"STRESS_SCORE": "stress_score", "SLEEP_POINTS": "sleep_points", "RESPONSIVENESS_POINTS": "responsiveness_points", "EXERTION_POINTS": "exertion_points"}, {"STATUS": "stress_status", "CALCULATION_FAILED": "_failed"})
    return out.filter(F.coalesce(F.lower(F.trim("_failed")) != "true", F.lit(True))).drop("_failed")


def hrv_summary(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _daily(spark, paths, "timestamp", {"rmssd": "daily_rmssd", "nremhr": "nremhr_bpm", "entropy": "entropy"})


def resp_rate_daily(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _daily(spark, paths, "timestamp", {"daily_respiratory_rate": "rr_nightly"})


def resp_rate_stage(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Columns go by a long or a short name; the first that has a number counts."""
    stages = ("deep", "light", "rem", "full")
    long, short = [f"{s}_sleep_breathing_rate" for s in stages], [f"{s}_breathing_rate" for s in stages]
    out = _daily(spark, paths, "timestamp", {c: c for c in (*long, *short, "signal_to_noise")})
    return out.select("night", *[F.coalesce(a, b).alias(f"rr_{s}") for s, a, b in zip(stages, long, short, strict=True)], F.col("signal_to_noise").alias("rr_signal_to_noise"), "file", "ok")


def azm(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _daily(spark, paths, "date_time", {"total_minutes": "azm_minutes"}, {"heart_zone_id": "zone"})


def daily_activity(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    raw = _json(spark, paths, "dateTime string, value string")
    out = raw.select(F.to_date(F.coalesce(X.us_timestamp("dateTime"), X.iso_wall("dateTime"))).alias("night"), _num("value").alias(name), "file")
    return split_rows(out, F.col("night").isNotNull() & F.col(name).isNotNull())


def summed(rows: DataFrame, name: str) -> DataFrame:
    """Minutes or steps of a date over all rows and files."""
    return kept(rows).groupBy("night").agg(F.sum(name).alias(name))


def temperature(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _daily(spark, paths, "sleep_start", {"nightly_temperature": "skin_temperature"})


def spo2_daily(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _daily(spark, paths, "timestamp", {"average_value": "spo2_average", "lower_bound": "spo2_lower", "upper_bound": "spo2_upper"})


def _minutes(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp")) / 60


def spo2_minute(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Instants; the sentinel reading 50.0 is kept for later."""
    raw = _csv(spark, paths, ["timestamp", "value"])
    out = raw.select(_minutes(X.iso_instant("timestamp")).alias("utc_min"), _num("value").alias("value"), "file")
    return split_rows(out, F.col("utc_min").isNotNull() & F.col("value").isNotNull())


def _local_series(spark: SparkSession, paths: list[str], names: dict[str, str], texts: tuple[str, ...] = ()) -> DataFrame:
    raw = _csv(spark, paths, ["timestamp", *names, *texts])
    out = raw.select(_minutes(X.iso_wall("timestamp")).alias("local_min"), *[_num(c).alias(n) for c, n in names.items()], *texts, "file")
    return split_rows(out, F.col("local_min").isNotNull())


def hrv_details(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _local_series(spark, paths, {c: c for c in ("rmssd", "coverage", "low_frequency", "high_frequency")})


def snore(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _local_series(spark, paths, {"mean_dba": "mean_dba", "max_dba": "max_dba"}, ("snore_label",))


def heart_rate(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = _json(spark, paths, "dateTime string, value struct<bpm:double, confidence:double>")
    at = F.coalesce(X.us_timestamp("dateTime"), X.iso_wall("dateTime"))
    out = raw.select(_minutes(at).alias("local_min"), F.col("value.bpm").alias("bpm"), F.col("value.confidence").alias("confidence"), "file")
    return split_rows(out, F.col("local_min").isNotNull() & F.col("bpm").isNotNull())


PARSERS = {
    "sleep": sleep, "sleep_score": sleep_score, "user_sleeps": user_sleeps, "resting_hr": resting_hr, "hr_zones": hr_zones, "readiness": readiness, "stress": stress,
    "hrv_summary": hrv_summary, "resp_rate_daily": resp_rate_daily, "resp_rate_stage": resp_rate_stage, "azm": azm,
    "steps": lambda spark, paths: daily_activity(spark, paths, "steps"), "active_minutes": lambda spark, paths: daily_activity(spark, paths, "active_minutes"),
    "temperature": temperature, "spo2_daily": spo2_daily, "spo2_minute": spo2_minute, "hrv_details": hrv_details, "snore": snore, "heart_rate": heart_rate,
}
