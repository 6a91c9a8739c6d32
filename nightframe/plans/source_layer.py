"""Queries of the readers and stores: the test tables are written as the files that a reader expects, and read back.

Days are moved by 11,000, as the readers take no date before 2000. Files of one kind come with headers of their own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.functions import exprs as X
from nightframe.operators import explorer
from nightframe.operators import wearable as N
from nightframe.plans.frames import NIGHTS, log, nights, table
from nightframe.plans.nightly import r, rounded
from nightframe.plans.wearable_layer import DENSE, night_samples, windows
from nightframe.sources import files, store, tabular
from nightframe.sources import parsers as R
from nightframe.streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, in local mode a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/files-{uuid.uuid4().hex}"


def put_csv(spark: SparkSession, *frames: DataFrame) -> list[str]:
    """CSV files of each frame, with headers."""
    out = []
    for frame in frames:
        path = scratch(spark)
        frame.write.csv(path, header=True, quote='"', escape='"')
        out += [f for f in files.files_of(spark, path) if f.endswith(".csv")]
    return out


def put_json(spark: SparkSession, rows: DataFrame, item: Column, day: str, most: int = 5000) -> list[str]:
    """Files of about ``most`` rows of a month, each an array of what ``item`` gives for its rows."""
    path, x = scratch(spark), rows.select(F.date_format(day, "yyyyMM").alias("month"), F.to_json(item).alias("item"))
    # a row for each month
    parts = F.broadcast(x.groupBy("month").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")))
    dealt = x.join(parts, "month").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
    arrays = dealt.groupBy("month", "part").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("item")), F.lit("]")).alias("value"))
    arrays.write.partitionBy("month", "part").text(path)
    return [f for f in files.files_of(spark, path) if f.endswith(".txt")]


def days(spark: SparkSession, sf: str) -> DataFrame:
    return nights(spark, sf).withColumn("night", F.date_add("day", 11_000))


DAYS = f"{NIGHTS}, b AS (SELECT day + 11000 AS night, n, v, w FROM nights)"


def midnight() -> Column:
    return F.concat(F.date_format("night", "yyyy-MM-dd"), F.lit("T00:00:00"))


@query("S02_read_summary", f"WITH {NIGHTS} SELECT day, {r('n * 437 / 3600.0::DOUBLE', 'usage_hours')}, {r('v', 'ahi')}, {r('w', 'median_epap')} FROM nights")
def _(spark, sf):
    sec = F.col("n") * 437
    text = F.concat_ws(":", F.floor(sec / 3600).cast("string"), F.lpad(F.floor(sec % 3600 / 60).cast("string"), 2, "0"), F.lpad((sec % 60).cast("string"), 2, "0"))
    rows = nights(spark, sf).select(F.col("day").alias("Date"), text.alias("Total Time"), F.col("v").alias("AHI"), F.col("w").alias("Median EPAP"))
    paths = put_csv(spark, rows.filter("month(Date) < 7"), rows.filter("month(Date) >= 7").select("AHI", "Median EPAP", "Date", "Total Time"))
    return rounded(tabular.read_summary(spark, paths).select("day", "usage_hours", "ahi", "median_epap"))


@query("S03_read_details", f"SELECT event_type AS event, count(*) AS n, {r('sum(value)', 'total')} FROM events GROUP BY 1")
def _(spark, sf):
    rows = log(spark, sf).select(F.col("event_type").alias("Event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("DateTime"), F.col("value").alias("Data/Duration"))
    paths = put_csv(spark, rows, spark.createDataFrame([("x", "no time", 1.0)], "Event string, DateTime string, `Data/Duration` double"))
    return rounded(tabular.read_details(spark, paths).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("S12_sleep", f"""WITH {DAYS} SELECT n * 1000 + dayofyear(night) AS log_id, night AS date_of_sleep, night - INTERVAL 1 HOUR AS start_local, {r('v * 50', 'asleep_min')}, {r('w', 'deep_min')} FROM b WHERE n % 5 <> 0""")
def _(spark, sf):
    at = lambda hours: F.date_format(F.col("night").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    log_id = F.when(F.col("n") % 5 != 0, F.col("n") * 1000 + F.dayofyear("night"))
    levels = F.struct(F.struct(F.struct(F.col("w").alias("minutes")).alias("deep")).alias("summary"))
    item = F.struct(log_id.alias("logId"), F.date_format("night", "yyyy-MM-dd").alias("dateOfSleep"), at(-1).alias("startTime"), at(7).alias("endTime"), F.lit(True).alias("mainSleep"), (F.col("v") * 50).alias("minutesAsleep"), levels.alias("levels"))
    rows = R.PARSERS["sleep"](spark, put_json(spark, days(spark, sf), item, "night"))
    return rounded(R.kept(rows).select("log_id", "date_of_sleep", "start_local", "asleep_min", "deep_min"))


def _scores(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.when(k % 10 == 0, "x").otherwise(k.cast("string")).alias("sleep_log_entry_id"), F.col("o_totalprice").alias("overall_score"), F.col("o_custkey").alias("composition_score"), k)
    paths = put_csv(spark, rows.filter("o_orderkey % 2 = 0").drop("o_orderkey"), rows.filter("o_orderkey % 2 = 1").select("composition_score", "o_orderkey", "overall_score", "sleep_log_entry_id"))
    return R.PARSERS["sleep_score"](spark, paths)


@query("S13_sleep_score", f"SELECT o_orderkey AS log_id, {r('o_totalprice', 'score')}, {r('o_custkey::DOUBLE', 'composition_score')} FROM orders WHERE o_orderkey % 10 <> 0")
def _(spark, sf):
    return rounded(R.kept(_scores(spark, sf)).select("log_id", "score", "composition_score"))


@query("S31_malformed", "SELECT CAST(count(*) FILTER (o_orderkey % 10 = 0) AS BIGINT) AS malformed, count(*) AS rows FROM orders")
def _(spark, sf):
    return R.malformed(_scores(spark, sf)).agg(F.sum("malformed").alias("malformed"), F.sum("rows").alias("rows"))


@query("S14_user_sleeps", f"""WITH {DAYS}, x AS (SELECT night, CASE date_diff('day', DATE '2020-01-01', night) % 3 WHEN 0 THEN -480 WHEN 1 THEN 330 ELSE 0 END AS h FROM b)
SELECT CASE WHEN h = -480 THEN night - 1 ELSE night END AS night, CAST(arg_min(h, x.night) AS BIGINT) AS hint FROM x GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    k = F.datediff("night", F.lit("2020-01-01").cast("date")) % 3
    rows = days(spark, sf).select(F.concat(F.date_format("night", "yyyy-MM-dd"), F.lit("T06:00:00Z")).alias("sleep_start"), F.when(k == 0, "-08:00").when(k == 1, "+05:30").otherwise("+00:00").alias("start_utc_offset"))
    return rounded(R.first_hint(R.PARSERS["user_sleeps"](spark, put_csv(spark, rows.coalesce(1)))))


@query("S15_resting_hr", f"WITH {DAYS} SELECT night, {r('w - 25', 'resting_bpm')} FROM b WHERE w > 25")
def _(spark, sf):
    value = F.struct(F.date_format("night", "MM/dd/yy").alias("date"), (F.col("w") - 25).alias("value"))
    rows = R.PARSERS["resting_hr"](spark, put_json(spark, days(spark, sf), F.struct(value.alias("value")), "night"))
    return rounded(R.kept(rows).select("night", "resting_bpm"))


@query("S16_hr_zones", f"WITH {DAYS} SELECT night, {r('v', 'zone0_min')}, {r('w', 'zone1_min')}, CAST(NULL AS DOUBLE) AS zone2_min, {r('n::DOUBLE', 'zone3_min')} FROM b")
def _(spark, sf):
    zones = F.struct(F.col("v").alias("BELOW_DEFAULT_ZONE_1"), F.col("w").alias("IN_DEFAULT_ZONE_1"), F.col("n").alias("IN_DEFAULT_ZONE_3"))
    item = F.struct(F.date_format("night", "MM/dd/yy HH:mm:ss").alias("dateTime"), F.struct(zones.alias("valuesInZones")).alias("value"))
    rows = R.PARSERS["hr_zones"](spark, put_json(spark, days(spark, sf), item, "night"))
    return rounded(R.kept(rows).select("night", *[f"zone{k}_min" for k in range(4)]))


def daily(name: str, metric: str, columns: dict[str, tuple[str, str]], at: str = "timestamp", where: str = "true", texts: dict[str, tuple[str, str]] | None = None, failed: str | None = None) -> None:
    """A daily CSV reader: ``columns`` maps what it gives to the file's column and the value there. Half of the files have
    their columns in reverse order."""
    texts = texts or {}
    sql = ", ".join([r(f"({e})::DOUBLE", out) for out, (_, e) in columns.items()] + [f"{e} AS {out}" for out, (_, e) in texts.items()])

    def run(spark, sf):
        written = [F.expr(e).alias(c) for c, e in [*columns.values(), *texts.values()]]
        rows = days(spark, sf).select(midnight().alias(at), *written, *([F.expr(failed).alias("CALCULATION_FAILED")] if failed else []), (F.month("night") % 2).alias("_half"))
        names = [c for c in rows.columns if c != "_half"]
        paths = put_csv(spark, rows.filter("_half = 0").select(*names), rows.filter("_half = 1").select(*names[::-1]))
        return rounded(R.kept(R.PARSERS[metric](spark, paths)).select("night", *columns, *texts))

    query(name, f"WITH {DAYS} SELECT night, {sql} FROM b WHERE {where}")(run)


daily("S17_readiness", "readiness", {"readiness_score": ("readiness_score_value", "v"), "activity_sub": ("activity_subcomponent", "w"), "hrv_sub": ("hrv_subcomponent", "n")}, "date", texts={"readiness_state": ("readiness_state", "concat('a, \"', n, '\"')")})
daily("S18_stress", "stress", {"stress_score": ("STRESS_SCORE", "v"), "sleep_points": ("SLEEP_POINTS", "w")}, "DATE", "n % 3 <> 0", {"stress_status": ("STATUS", "concat('READY ', n)")}, "n % 3 = 0")
daily("S19_hrv_summary", "hrv_summary", {"daily_rmssd": ("rmssd", "v"), "nremhr_bpm": ("nremhr", "w"), "entropy": ("entropy", "n")})
daily("S20_resp_rate_daily", "resp_rate_daily", {"rr_nightly": ("daily_respiratory_rate", "v")})
daily("S24_temperature", "temperature", {"skin_temperature": ("nightly_temperature", "v + w")}, "sleep_start")
daily("S25_spo2_daily", "spo2_daily", {"spo2_average": ("average_value", "v"), "spo2_lower": ("lower_bound", "v - 1"), "spo2_upper": ("upper_bound", "w")})


@query("S21_resp_rate_stage", f"WITH {DAYS} SELECT night, {r('v', 'rr_deep')}, {r('w', 'rr_light')}, {r('CASE WHEN n % 2 = 1 THEN n::DOUBLE END', 'rr_signal_to_noise')} FROM b")
def _(spark, sf):
    rows = days(spark, sf).withColumn("timestamp", midnight())
    long = rows.filter("n % 2 = 0").select("timestamp", F.col("v").alias("deep_sleep_breathing_rate"), F.col("w").alias("light_sleep_breathing_rate"))
    short = rows.filter("n % 2 = 1").select(F.col("w").alias("light_breathing_rate"), F.col("v").alias("deep_breathing_rate"), F.col("n").alias("signal_to_noise"), "timestamp")
    return rounded(R.kept(R.PARSERS["resp_rate_stage"](spark, put_csv(spark, long, short))).select("night", "rr_deep", "rr_light", "rr_signal_to_noise"))


@query("S22_azm", "SELECT CAST(ts AS DATE) AS night, round(sum(value), 4) AS azm_minutes FROM events GROUP BY 1")
def _(spark, sf):
    rows = log(spark, sf).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("date_time"), F.col("event_type").alias("heart_zone_id"), F.col("value").alias("total_minutes"))
    out = R.summed(R.PARSERS["azm"](spark, put_csv(spark, rows, rows.limit(0))), "azm_minutes")
    return out.select("night", F.round("azm_minutes", 4).alias("azm_minutes"))


@query("S23_steps", "SELECT CAST(ts AS DATE) AS night, CAST(sum(floor(value)) AS DOUBLE) AS steps FROM events GROUP BY 1")
def _(spark, sf):
    item = F.struct(F.date_format("ts", "MM/dd/yy HH:mm:ss").alias("dateTime"), F.floor("value").cast("string").alias("value"))
    return rounded(R.summed(R.PARSERS["steps"](spark, put_json(spark, log(spark, sf), item, "ts")), "steps"))


SECONDS = "floor(epoch_us(ts) / 1e6)"


@query("S26_spo2_minute", f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, {r(f'sum({SECONDS} / 60 % 1440)', 'minutes')}, {r('sum(value)', 'total')} FROM events GROUP BY 1")
def _(spark, sf):
    rows = log(spark, sf).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "value")
    found = R.kept(R.PARSERS["spo2_minute"](spark, put_csv(spark, rows)))
    return _by_day(found, "utc_min", F.col("value"))


def _by_day(found: DataFrame, minute: str, value: Column) -> DataFrame:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(minute) / 1440).cast("int"))
    return rounded(found.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(minute) % 1440).alias("minutes"), F.sum(value).alias("total")))


@query("S27_hrv_details", f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, {r(f'sum({SECONDS} / 60 % 1440)', 'minutes')}, {r('sum(value + event_id % 7)', 'total')} FROM events GROUP BY 1")
def _(spark, sf):
    rows = log(spark, sf).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("value").alias("rmssd"), (F.col("event_id") % 7).alias("coverage"))
    found = R.kept(R.PARSERS["hrv_details"](spark, put_csv(spark, rows.filter("coverage < 3"), rows.filter("coverage >= 3").select("coverage", "rmssd", "timestamp"))))
    return _by_day(found, "local_min", F.col("rmssd") + F.col("coverage"))


@query("S28_snore", f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, {r(f'sum({SECONDS} / 60 % 1440)', 'minutes')}, {r('sum(value * 3 + length(event_type))', 'total')} FROM events GROUP BY 1")
def _(spark, sf):
    rows = log(spark, sf).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("value").alias("mean_dba"), (F.col("value") * 2).alias("max_dba"), F.col("event_type").alias("snore_label"))
    found = R.kept(R.PARSERS["snore"](spark, put_csv(spark, rows)))
    return _by_day(found, "local_min", F.col("mean_dba") + F.col("max_dba") + F.length("snore_label"))


@query("S29_heart_rate", f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, {r(f'sum({SECONDS} / 60 % 1440)', 'minutes')}, {r('sum(value + event_id % 4)', 'total')} FROM events GROUP BY 1")
def _(spark, sf):
    value = F.struct(F.col("value").alias("bpm"), (F.col("event_id") % 4).alias("confidence"))
    item = F.struct(F.date_format("ts", "MM/dd/yy HH:mm:ss").alias("dateTime"), value.alias("value"))
    found = R.kept(R.PARSERS["heart_rate"](spark, put_json(spark, log(spark, sf), item, "ts")))
    return _by_day(found, "local_min", F.col("bpm") + F.col("confidence"))


@query("S38_store", f"""WITH {NIGHTS}, s AS (SELECT day AS night, CASE WHEN n % 3 = 0 THEN v + 100 ELSE v END AS v FROM nights) SELECT night, {r('v', 'v')} FROM s WHERE night BETWEEN DATE '1995-02-15' AND DATE '1996-03-10'""")
def _(spark, sf):
    """Upserted twice, the second time for every third night, and read back for a range."""
    path, rows = scratch(spark), nights(spark, sf).select(F.col("day").alias("night"), "n", "v")
    store.upsert(spark, path, rows, ["night"])
    store.upsert(spark, path, rows.filter("n % 3 = 0").withColumn("v", F.col("v") + 100), ["night"])
    return rounded(store.nights_between(spark, path, "1995-02-15", "1996-03-10").select("night", "v"))


@query("S39_intraday", "SELECT event_id, value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05' AND event_type = 'view'")
def _(spark, sf):
    path = scratch(spark)
    rows = log(spark, sf).select("event_id", "value", F.col("event_type").alias("metric"), F.to_date("ts").alias("night"))
    store.upsert(spark, path, rows, ["event_id"])
    return store.intraday(spark, path, "2024-01-05", "view").select("event_id", "value")


@query("S41_session", f"WITH {NIGHTS} SELECT 'summary' AS part, count(*) AS n, {r('sum(v)', 'total')} FROM nights UNION ALL SELECT 'details', count(*), {r('sum(value)', 'total')} FROM events UNION ALL SELECT 'settings', 2, 7.0")
def _(spark, sf):
    path = scratch(spark)
    store.save_session(spark, path, nights(spark, sf), log(spark, sf), {"gap": "3", "k": "4"})
    summary, details, settings = store.load_session(spark, path)
    parts = [summary.agg(F.lit("summary").alias("part"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), details.agg(F.lit("details").alias("part"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))]
    kept = spark.createDataFrame([("settings", len(settings), float(sum(map(int, settings.values()))))], "part string, n bigint, total double")
    return rounded(parts[0].unionByName(parts[1]).unionByName(kept))


@query("S46_protected", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    return store.decrypt_rows(store.encrypt_rows(rows, "Passphrase-123!"), "Passphrase-123!", "c_custkey bigint, c_name string")


@query("A14_hrv", f"""WITH {DENSE}, x AS (SELECT night, value AS v, event_id % 100 / 99.0::DOUBLE AS c FROM wn JOIN sm ON t >= a AND t < a + 480)
SELECT night, count(*) AS hrv_windows, {r('CASE WHEN avg(c) >= 0.5 THEN avg(v) END', 'rmssd_ms')}, avg(c) < 0.5 AS insufficient FROM x GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    samples = night_samples(spark, sf).select("local_min", F.col("value").alias("rmssd"), (F.col("event_id") % 100 / F.lit(99.0)).alias("coverage"))
    out = N.hrv_nightly(N.assign_local(windows(spark, sf), samples, ["rmssd", "coverage"]))
    return rounded(out.select("night", "hrv_windows", F.col("hrv.rmssd_ms").alias("rmssd_ms"), F.col("hrv_insufficient").alias("insufficient")))


@query("A16_snore", f"""WITH {DENSE.replace('event_id,', 'event_id, event_type,')}, x AS (SELECT night, value AS v, event_type AS l FROM wn JOIN sm ON t >= a AND t < a + 480)
SELECT night, count(*) AS snore_epochs, {r("0.5::DOUBLE * count(*) FILTER (l <> 'view')", 'snore_minutes')}, {r("50 * count(*) FILTER (l <> 'view') / 400.0::DOUBLE", 'pct')}, {r('avg(v)', 'mean_dba')}, {r('max(v) * 2', 'max_dba')} FROM x GROUP BY 1 HAVING count(*) >= 120""")  # fmt: skip
def _(spark, sf):
    labelled = F.when(F.col("event_type") == "view", " None ").otherwise(F.col("event_type"))
    samples = night_samples(spark, sf).join(log(spark, sf).select("event_id", "event_type"), "event_id")
    samples = samples.select("local_min", F.col("value").alias("mean_dba"), (F.col("value") * 2).alias("max_dba"), labelled.alias("snore_label"))
    own = windows(spark, sf)
    out = N.snore_nightly(N.assign_local(own, samples, ["mean_dba", "max_dba", "snore_label"]), own.withColumn("asleep_min", F.lit(400.0))).filter("snore is not null")
    return rounded(out.select("night", "snore_epochs", F.col("snore.snore_minutes").alias("snore_minutes"), F.col("snore.snore_pct_of_sleep").alias("pct"), F.col("snore.mean_dba").alias("mean_dba"), F.col("snore.max_dba").alias("max_dba")))


def _sessions(spark, sf):
    """Orders as sessions: their date is the date of sleep, every third is classic, some lack stages."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice") / 1000
    start = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(k % 300).cast("int"))
    null = F.lit(None).cast("double")
    return table(spark, sf, "orders").select(
        k.alias("log_id"), F.to_date("o_orderdate").alias("date_of_sleep"), start.alias("start_local"), (start + F.expr("INTERVAL 5 HOURS")).alias("end_local"), F.when(k % 3 == 0, "classic").otherwise("stages").alias("type"),
        F.lit(True).alias("main_sleep"), (p + 60).alias("time_in_bed_min"), p.alias("asleep_min"), (k % 50).cast("double").alias("awake_min"), F.when(k % 7 != 0, (k % 11).cast("double")).alias("onset_latency_min"),
        F.when(k % 2 == 0, F.lit(3.0)).alias("after_wakeup_min"), F.lit(90.0).alias("efficiency_pct"), F.when(k % 4 != 0, p / 5).alias("deep_min"), (p / 2).alias("light_min"), null.alias("rem_min"), null.alias("wake_min"),
        (k % 9).cast("double").alias("restless_min"), F.when(k % 2 == 0, F.lit(2.0)).alias("awake_stage_min"), F.lit("f").alias("file"),
    )


SESSIONS = """x AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderdate::TIMESTAMP + to_minutes(CAST(o_orderkey % 300 AS BIGINT)) AS a, o_totalprice / 1000 AS p FROM orders),
y AS (SELECT *, CASE WHEN k % 3 = 0 THEN k % 9 + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END WHEN k % 7 <> 0 THEN greatest(0, k % 50 - k % 11 - CASE WHEN k % 2 = 0 THEN 3 ELSE 0 END) END AS waso,
 CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN p / 5 END AS deep FROM x)"""


@query("A22_sleep_architecture", f"WITH {SESSIONS} SELECT k AS log_id, {r('waso::DOUBLE', 'waso_min')}, {r('deep', 'deep_min')}, {r('100 * deep / p', 'deep_pct')}, k % 3 = 0 AS is_classic FROM y")
def _(spark, sf):
    return rounded(N.sleep_architecture(_sessions(spark, sf)).select("log_id", "waso_min", "deep_min", "deep_pct", "is_classic"))


@query("A21_fold_nights", f"""WITH {SESSIONS} SELECT d AS night, arg_min(k, struct_pack(a := a, k := k)) AS log_id, min(a) AS start_local, max(a) + INTERVAL 5 HOUR AS end_local, {r('sum(p)', 'asleep_min')}, {r('sum(waso)::DOUBLE', 'waso_min')}, {r('sum(deep)', 'deep_min')},
 count(*) > 1 AS split, bool_or(k % 3 = 0) AS classic FROM y GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    out = N.fold_nights(N.sleep_architecture(N.dedup_sessions(_sessions(spark, sf))))
    has = lambda flag: F.array_contains("flags", flag)
    return rounded(out.select("night", "log_id", "start_local", "end_local", "asleep_min", "waso_min", "deep_min", has("split-sleep").alias("split"), has("classic").alias("classic")))


@query("X19_stage_shares", f"WITH {SESSIONS}, z AS (SELECT *, CASE WHEN k % 3 <> 0 THEN p / 2 END AS light FROM y) SELECT k AS night, {r('100 * deep / nullif(coalesce(deep, 0) + coalesce(light, 0), 0)', 'deep_share')}, {r('100 * light / nullif(coalesce(deep, 0) + coalesce(light, 0), 0)', 'light_share')} FROM z")
def _(spark, sf):
    own = N.sleep_architecture(_sessions(spark, sf)).withColumn("night", F.col("log_id"))
    return rounded(N.stage_shares(own).select("night", "deep_share", "light_share"))


@query("J02_assembled", f"""WITH {DAYS}, e AS (SELECT night, CASE WHEN n % 2 = 0 THEN v END AS s, CASE WHEN n % 3 = 0 THEN w END AS t, n % 4 = 0 AS short FROM b)
SELECT night, {r('s', 'stress_score')}, {r('t', 'skin_temperature')}, short AS insufficient, {r('CASE WHEN NOT short THEN s END', 'rmssd')} FROM e""")  # fmt: skip
def _(spark, sf):
    d = days(spark, sf)
    daily_of = {"stress": d.filter("n % 2 = 0").select("night", F.col("v").alias("stress_score")), "temperature": d.filter("n % 3 = 0").select("night", F.col("w").alias("skin_temperature"))}
    rmssd = F.when(F.col("n") % 2 == 0, F.col("v"))
    measure = N.gated(d.select("night", "n", rmssd.alias("rmssd_ms")), "hrv", F.col("n") % 4 != 0, ["rmssd_ms"], [])
    own = N.assemble(d.select("night", F.array().cast("array<string>").alias("flags")), daily_of, [measure], ["hrv"])
    return rounded(own.select("night", "stress_score", "skin_temperature", F.array_contains("insufficient", "hrv").alias("insufficient"), F.col("hrv.rmssd_ms").alias("rmssd")))


@query("F03_range_pick", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'")
def _(spark, sf):
    return explorer.date_filter(_undated(spark, sf), "day", "1996-03-01", "1996-05-31", keep_undated=False).select("o_orderkey")


@query("F05_explorer_dates", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1996-03-01'")
def _(spark, sf):
    return explorer.date_filter(_undated(spark, sf), "day", "1996-03-01", None).select("o_orderkey")


def _undated(spark, sf):
    """Orders whose date is a text in one of two forms, and none for every fifth."""
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "soon").when(k % 5 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    return table(spark, sf, "orders").select(k, text.alias("day"))


@query("F06_columns", """SELECT c_custkey || ',' || c_mktsegment AS line FROM customer""")
def _(spark, sf):
    own = table(spark, sf, "customer")
    return explorer.csv_lines(own, [explorer.find_column(own, "^C_CUST"), explorer.find_column(own, "segment")])


@query("F12_summary_fields", f"WITH {NIGHTS} SELECT day, {r('v', 'ahi')}, {r('w', 'leak_median')}, {r('n::DOUBLE', 'max_pressure')}, CAST(NULL AS DOUBLE) AS central_ahi FROM nights")
def _(spark, sf):
    rows = nights(spark, sf).select(F.col("day").alias("Date"), F.lit("7:00:00").alias("Total Time"), F.concat("v", F.lit(" per hour")).alias("AHI"), F.col("w").alias("Median EPAP"), F.col("w").alias("Leak Rate Median"), F.col("n").alias("Max Pressure"))
    own = tabular.summary_fields(tabular.read_summary(spark, put_csv(spark, rows)))
    return rounded(own.select("day", "ahi", "leak_median", "max_pressure", "central_ahi"))


@query("X11_wall_minutes", f"SELECT event_id, {r('floor(epoch_us(ts) / 1e6) / 60', 'minutes')} FROM events")
def _(spark, sf):
    return rounded(log(spark, sf).select("event_id", X.wall_minutes("ts").alias("minutes")))


def put_export(spark: SparkSession, root: str, folder: str, prefix: str, frame: DataFrame) -> None:
    """Adds CSV files of a frame to an export folder, named as the export names them."""
    for k, source in enumerate(put_csv(spark, frame)):
        target, system = files.hadoop_path(spark, f"{root}/{folder}/{prefix}{uuid.uuid4().hex[:8]}-{k}.csv")
        system.mkdirs(target.getParent())
        system.rename(files.hadoop_path(spark, source)[0], target)


@query("S32_stream_ingest", """SELECT 'value' AS part, event_id AS sec, round(value, 6) + 0.0 AS value FROM events WHERE event_id % 50 <> 0
UNION ALL SELECT 'malformed', count(*), NULL FROM events WHERE event_id % 50 = 0
UNION ALL SELECT 'last second', max(event_id), NULL FROM events WHERE event_id % 50 <> 0""")
def _(spark, sf):
    """An export folder that grows: half of the events, a run, the other half and a file that may not be read, and a run."""
    root, out, state = scratch(spark), scratch(spark), scratch(spark)
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = F.when(F.col("event_id") % 50 == 0, F.lit("none")).otherwise(F.col("value").cast("string"))
    rows = log(spark, sf).select(F.col("event_id"), at.alias("timestamp"), value.alias("value"))
    for half in (0, 1):
        part = rows.filter(F.col("event_id") % 2 == half).drop("event_id")
        put_export(spark, root, "Oxygen Saturation (SpO2)", "Minute SpO2 - ", part)
        if half:
            put_export(spark, root, "Account", "Minute SpO2 - ", part)
        ingest.ingest_stream(spark, root, out, state)
    sec = F.round(F.col("utc_min") * 60).cast("bigint") - 1_700_000_000
    held = store.read_store(spark, f"{out}/spo2_minute").select(sec.alias("sec"), "value")
    bad = ingest.malformed_files(spark, out).agg(F.sum("malformed").alias("sec"))
    return rounded(
        held.select(F.lit("value").alias("part"), "sec", "value")
        .unionByName(bad.select(F.lit("malformed").alias("part"), "sec", F.lit(None).cast("double").alias("value")))
        .unionByName(held.agg(F.max("sec").alias("sec")).select(F.lit("last second").alias("part"), "sec", F.lit(None).cast("double").alias("value")))
    )
