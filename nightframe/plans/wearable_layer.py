"""Queries of the wearable layer over stand-ins: order dates are nights, events are samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe.operators import engine, inference
from nightframe.operators import wearable as N
from nightframe.plans.frames import NIGHTS, log, nights, table, usage
from nightframe.plans.inference_layer import mann_whitney_sql
from nightframe.plans.nightly import r, rounded
from nightframe.sources import store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def windows(spark, sf):
    """A night for each day of the event log, 23:00 to 07:00, in minutes; and the log as samples."""
    days = log(spark, sf).select(F.to_date("ts").alias("night")).distinct()
    start = F.datediff("night", F.lit("1970-01-01").cast("date")) * F.lit(1440.0) - 60
    return days.select("night", start.alias("start_min"), (start + 480).alias("end_min"))


def samples(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 6e7
    return log(spark, sf).select("event_id", at.alias("local_min"), at.alias("utc_min"), F.col("value"))


def night_samples(spark, sf):
    """The log with every day squeezed into eight hours, 23:00 to 07:00 of its night: dense enough for the gates."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 6e7
    day = F.floor(at / 1440) * 1440.0
    return log(spark, sf).select("event_id", (day - 60 + (at - day) / 3).alias("local_min"), "value")


def shifted_samples(spark, sf):
    """The log with every day squeezed into seven hours, 03:00 to 10:00 of universal time: one offset fits best."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 6e7
    day = F.floor(at / 1440) * 1440.0
    return log(spark, sf).select((day + 180 + F.floor((at - day) * 7 / 24)).alias("utc_min"))


WINDOWS = """wn AS (SELECT DISTINCT CAST(ts AS DATE) AS night, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 1440.0::DOUBLE - 60 AS a FROM events),
sm AS (SELECT event_id, epoch_us(ts) / 6e7 AS t, value FROM events)"""
_DAY = "floor(epoch_us(ts) / 6e7 / 1440) * 1440.0::DOUBLE"
DENSE = WINDOWS.replace("epoch_us(ts) / 6e7 AS t,", f"{_DAY} - 60 + (epoch_us(ts) / 6e7 - {_DAY}) / 3 AS t,")
SHIFTED = WINDOWS.replace("epoch_us(ts) / 6e7 AS t,", f"{_DAY} + 180 + floor((epoch_us(ts) / 6e7 - {_DAY}) * 7 / 24) AS t,")


@query("J04_samples_in_nights", f"WITH {WINDOWS} SELECT night, event_id FROM wn JOIN sm ON t >= a AND t < a + 480")
def _(spark, sf):
    return N.assign_local(windows(spark, sf), samples(spark, sf), ["event_id"]).select("night", "event_id")


SPO2 = """count(v) AS valid_minutes, count(*) FILTER (v0 = 50) AS sentinel_minutes_removed, count(*) FILTER (v < 70) AS sub_seventy_minutes"""


@query("A12_spo2", f"""WITH {DENSE}, x AS (SELECT night, 48 + floor(value % 52) AS v0, CASE WHEN 48 + floor(value % 52) <> 50 THEN 48 + floor(value % 52) END AS v FROM wn JOIN sm ON t >= a AND t < a + 480)
SELECT night, {SPO2}, {', '.join(r(f'CASE WHEN count(v) >= 120 THEN {e} END', n) for e, n in (('avg(v)', 'mean_pct'), ('quantile_cont(v, 0.5)', 'median_pct'), ('min(v)', 'min_pct'), ('quantile_cont(v, 0.05)', 'p5_pct'),
 ('100.0 * count(*) FILTER (v < 90) / count(v)', 'below_90'), ('100.0 * count(*) FILTER (v < 88) / count(v)', 'below_88')))}, count(v) < 120 AS insufficient FROM x GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    x = N.assign_local(windows(spark, sf), night_samples(spark, sf).withColumn("value", 48 + F.floor(F.col("value") % 52)), ["value"])
    s = N.spo2_nightly(x)
    fields = {"mean_pct": "mean_pct", "median_pct": "median_pct", "min_pct": "min_pct", "p5_pct": "p5_pct", "pct_time_below_90": "below_90", "pct_time_below_88": "below_88"}
    return rounded(s.select("night", "valid_minutes", "sentinel_minutes_removed", "sub_seventy_minutes", *[F.col(f"spo2.{k}").alias(v) for k, v in fields.items()], F.col("spo2_insufficient").alias("insufficient")))


@query("A13_heart_rate", f"""WITH {DENSE}, x AS (SELECT night, value AS v FROM wn JOIN sm ON t >= a AND t < a + 480 WHERE event_id % 12 <> 0)
SELECT night, count(v) AS sample_count, {', '.join(r(f'CASE WHEN count(v) >= 300 THEN {e} END', n) for e, n in (('min(v)', 'lo'), ('avg(v)', 'mean'), ('max(v)', 'hi'), ('quantile_cont(v, 0.1)', 'p10')))} FROM x GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    x = N.assign_local(windows(spark, sf), night_samples(spark, sf).withColumn("bpm", F.col("value")).withColumn("confidence", F.when(F.col("event_id") % 12 == 0, 0.0).otherwise(1.0)), ["bpm", "confidence"])
    return rounded(N.hr_nightly(x).select("night", "sample_count", F.col("hr.sleeping_min").alias("lo"), F.col("hr.sleeping_avg").alias("mean"), F.col("hr.sleeping_max").alias("hi"), F.col("hr.sleeping_p10").alias("p10")))


@query("T27_offset_scores", f"""WITH {WINDOWS}, k AS (SELECT unnest(generate_series(-840, 840, 15)) AS o), x AS (SELECT night, a, t FROM wn JOIN sm ON t >= a - 840 AND t < a + 480 + 840),
c AS (SELECT night, o, count(*) FILTER (t + o >= a AND t + o < a + 480) AS i, count(*) AS n FROM x, k GROUP BY 1, 2) SELECT night, CAST(o AS BIGINT) AS "offset", i AS inside, n AS total, {r('i / n::DOUBLE', 'share')} FROM c""")  # fmt: skip
def _(spark, sf):
    return rounded(N.offset_scores(N.samples_near(windows(spark, sf), samples(spark, sf).select("utc_min"))))


# the nights one after the other, by recursion
@query("T27_infer_offsets", f"""WITH RECURSIVE {SHIFTED}, k AS (SELECT unnest(generate_series(-840, 840, 15)) AS o), x AS (SELECT night, a, t FROM wn JOIN sm ON t >= a - 840 AND t < a + 480 + 840),
c AS (SELECT night, o, count(*) FILTER (t + o >= a AND t + o < a + 480) AS i, count(*) AS n FROM x, k GROUP BY 1, 2), h AS (SELECT *, max(i) OVER (PARTITION BY night) AS top FROM c),
b AS (SELECT night, list(o ORDER BY o) AS ties, max(i) AS i, max(n) AS n, row_number() OVER (ORDER BY night) AS k FROM h WHERE i = top GROUP BY night),
s AS (SELECT k, CAST(NULL AS BIGINT) AS o, CAST(NULL AS BIGINT) AS prev FROM (SELECT 0 AS k)
 UNION ALL SELECT k, CASE WHEN n >= 30 THEN c END, CASE WHEN n >= 30 AND i / n::DOUBLE >= 0.5 THEN c ELSE prev END FROM (SELECT b.k, n, i, prev,
 list_sort(list_transform(ties, lambda z: {{'d': abs(z - coalesce(prev, 0)), 's': abs(z), 'o': z}}))[1].o AS c FROM s JOIN b ON b.k = s.k + 1) y),
m AS (SELECT night, floor((a - t) / 15 + 0.5) * 15 AS d, count(*) AS q FROM x GROUP BY 1, 2), e AS (SELECT night, d, row_number() OVER (PARTITION BY night ORDER BY q DESC, d) AS p FROM m)
SELECT b.night, CAST(o AS BIGINT) AS "offset", {r('CASE WHEN n >= 30 THEN i / n::DOUBLE ELSE 0 END', 'share')}, n AS total, n >= 30 AND i / n::DOUBLE >= 0.5 AS confident,
 coalesce(n >= 30 AND abs(d - o) > 15, false) AS unstable FROM b JOIN s USING (k) JOIN e ON b.night = e.night AND e.p = 1""")  # fmt: skip
def _(spark, sf):
    found = N.infer_offsets(N.samples_near(windows(spark, sf), shifted_samples(spark, sf)))
    return rounded(found.select("night", "offset", "share", "total", "confident", "unstable"))


CHAIN = "SELECT CAST(o_orderdate AS DATE) AS night, min(o_orderkey) AS k FROM orders GROUP BY 1"


@query("T28_resolve_offsets", f"""WITH c AS ({CHAIN}), x AS (SELECT night, CASE WHEN k % 3 = 0 THEN CAST(k % 7 * 60 AS INT) END AS off, CASE WHEN k % 5 = 0 THEN CAST(k % 4 * 60 AS INT) END AS hint FROM c),
y AS (SELECT x.*, (SELECT arg_max(off, night) FROM x p WHERE p.night < x.night AND p.off IS NOT NULL AND p.night >= x.night - 2) AS carried FROM x)
SELECT night, CAST(coalesce(off, CASE WHEN hint <> 0 THEN hint END, carried, -480) AS BIGINT) AS utc_offset_min,
 CASE WHEN off IS NOT NULL THEN 'inferred' WHEN hint <> 0 THEN 'userSleeps-hint' WHEN carried IS NOT NULL THEN 'carry-forward' ELSE 'default-fallback' END AS window_source,
 CAST(CASE WHEN off IS NOT NULL AND hint <> 0 AND abs(hint - off) >= 15 THEN abs(hint - off) END AS BIGINT) AS offset_disagreement_min FROM y""")  # fmt: skip
def _(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("night")).agg(F.min("o_orderkey").alias("k"))
    off = F.when(F.col("k") % 3 == 0, (F.col("k") % 7 * 60).cast("int"))
    hint = F.when(F.col("k") % 5 == 0, (F.col("k") % 4 * 60).cast("int"))
    return rounded(N.resolve_offsets(c.select("night", off.alias("offset"), off.isNotNull().alias("confident"), hint.alias("hint"))))


@query("A24_offset_provenance", f"""WITH c AS ({CHAIN}), x AS (SELECT CASE k % 4 WHEN 0 THEN 'inferred' WHEN 1 THEN 'userSleeps-hint' WHEN 2 THEN 'carry-forward' ELSE 'default-fallback' END AS s FROM c)
SELECT count(*) AS n, {', '.join(r(f"count(*) FILTER (s = '{k}') / count(*)::DOUBLE", v) for k, v in (('inferred', 'inferred_pct'), ('userSleeps-hint', 'hint_pct'), ('carry-forward', 'carry_forward_pct'), ('default-fallback', 'default_fallback_pct')))} FROM x""")  # fmt: skip
def _(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("night")).agg(F.min("o_orderkey").alias("k"))
    kinds = F.array(*[F.lit(x) for x in ("inferred", "userSleeps-hint", "carry-forward", "default-fallback")])
    return rounded(N.offset_provenance(c.select(F.element_at(kinds, (F.col("k") % 4 + 1).cast("int")).alias("window_source"))))


@query("A19_downsample", """WITH x AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, value FROM events), f AS (SELECT user_id, min(s) AS t0 FROM x GROUP BY 1),
b AS (SELECT x.user_id, CAST(floor((s - t0) / 86400) AS BIGINT) AS k, CAST(floor(avg(value) + 0.5) AS BIGINT) AS v FROM x JOIN f USING (user_id) GROUP BY 1, 2) SELECT user_id, k, v FROM b WHERE v <> 0""")
def _(spark, sf):
    points = log(spark, sf).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sec"), "value")
    s = N.downsample(points, "value", 86400, ["user_id"])
    long = N.expand_series(s, ["user_id"]).join(s.select("user_id", "t0"), "user_id").filter("value is not null")
    return long.select("user_id", F.floor((F.col("sec") - F.col("t0")) / 86400 + 0.5).cast("long").alias("k"), F.col("value").cast("long").alias("v"))


@query("A20_first_writer", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey FROM x WHERE k = 1")
def _(spark, sf):
    o = table(spark, sf, "orders")
    s = o.select(F.col("o_custkey").alias("log_id"), F.lit(True).alias("main_sleep"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("file"), F.col("o_orderkey").alias("start_local"), F.col("o_orderkey").alias("end_local"))
    return N.dedup_sessions(s).select(F.col("log_id").alias("o_custkey"), F.col("start_local").alias("o_orderkey"))


@query("S33_last_writer", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey FROM x WHERE k = 1")
def _(spark, sf):
    return store.last_writer(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("S34_merge_activity", f"WITH {NIGHTS} SELECT coalesce(u.day, s.day) AS night, n AS steps, {r('w', 'azm')} FROM usage_ u FULL JOIN shipped_ s ON u.day = s.day")
def _(spark, sf):
    from nightframe.plans.frames import shipped

    return rounded(store.merge_activity(usage(spark, sf).select(F.col("day").alias("night"), F.col("n").alias("steps")), shipped(spark, sf).select(F.col("day").alias("night"), F.col("w").alias("azm"))))


@query("S35_unread", "SELECT o_orderkey AS relative, o_custkey AS size FROM orders WHERE o_orderkey % 3 <> 0")
def _(spark, sf):
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("relative"), F.col("o_custkey").alias("size"))
    return store.unread(files, files.filter("relative % 3 = 0"))


@query("S36_high_water", "SELECT event_type AS metric, max(CAST(ts AS DATE)) AS high_water FROM events GROUP BY 1")
def _(spark, sf):
    return store.high_water(log(spark, sf).select(F.col("event_type").alias("metric"), F.to_date("ts").alias("night")))


@query("S22_sum_by_date", "SELECT CAST(ts AS DATE) AS night, round(sum(value), 4) AS azm_minutes FROM events GROUP BY 1")
def _(spark, sf):
    from nightframe.sources import parsers

    rows = log(spark, sf).select(F.to_date("ts").alias("night"), F.col("value").alias("azm_minutes"), F.lit(True).alias("ok"))
    return parsers.summed(rows, "azm_minutes").select("night", F.round("azm_minutes", 4).alias("azm_minutes"))


def _sides(spark, sf):
    n = nights(spark, sf)
    row = F.datediff("day", F.lit("1990-01-01").cast("date"))
    summary = n.filter(row % 4 != 0).select(row.alias("row_id"), "day", F.col("v").alias("usage_hours"))
    worn = n.filter(row % 3 != 0).select(F.col("day").alias("night"), (F.col("w") * 15).alias("asleep_min"), F.lit(None).cast("double").alias("window_min"))
    return summary, worn


SIDES = f"""{NIGHTS}, i AS (SELECT *, date_diff('day', DATE '1990-01-01', day) AS row FROM nights), su AS (SELECT row, day, v AS u FROM i WHERE row % 4 <> 0), we AS (SELECT day AS night, w * 15 AS m FROM i WHERE row % 3 <> 0),
ov AS (SELECT su.row, su.day, we.night, greatest(0, coalesce(least(u, m / 60), m / 60, u, 0)) AS h, date_diff('day', su.day, we.night) AS sh, u, m FROM su JOIN we ON abs(date_diff('day', su.day, we.night)) <= 1),
e AS (SELECT * FROM ov WHERE sh = 0)"""


def _round(k: int, before: str) -> str:
    return f"""q{k} AS (SELECT ov.*, row_number() OVER (PARTITION BY row ORDER BY h DESC, sh) AS pr FROM ov WHERE sh <> 0 AND h >= 4 AND row NOT IN (SELECT row FROM {before}) AND night NOT IN (SELECT night FROM {before})),
p{k} AS (SELECT *, row_number() OVER (PARTITION BY night ORDER BY h DESC, day, row) AS pn FROM q{k} WHERE pr = 1),
d{k} AS (SELECT row, day, night, h, sh, u, m FROM {before} UNION ALL SELECT row, day, night, h, sh, u, m FROM p{k} WHERE pn = 1)"""


@query("J06_align", f"""WITH {SIDES}, {_round(1, 'e')}, {_round(2, 'd1')} SELECT CAST(row AS BIGINT) AS row_id, day, night, {r('u', 'usage_hours')}, {r('h', 'overlap_hours')},
 CASE sh WHEN 0 THEN 'exact' WHEN 1 THEN 'shifted+1' ELSE 'shifted-1' END AS match_type, coalesce(abs(u - m / 60) > 2, false) AS duration_mismatch FROM d2""")  # fmt: skip
def _(spark, sf):
    return rounded(N.align(*_sides(spark, sf)))


@query("A26_alignment_statistics", f"""WITH {SIDES}, {_round(1, 'e')}, {_round(2, 'd1')} SELECT (SELECT count(*) FROM su) AS summary_total, (SELECT count(*) FROM we) AS wearable_total, count(*) AS aligned,
 count(*) FILTER (sh = 0) AS exact, count(*) FILTER (sh = -1) AS shifted_before, count(*) FILTER (sh = 1) AS shifted_after, {r('count(*) / (SELECT count(*) FROM su)::DOUBLE', 'match_rate')} FROM d2""")  # fmt: skip
def _(spark, sf):
    summary, worn = _sides(spark, sf)
    return rounded(N.alignment_statistics(summary, worn, N.align(summary, worn)))


def _engine_nights(spark, sf):
    n = nights(spark, sf).filter("w is not null")
    day = F.datediff("day", F.lit("1990-01-01").cast("date"))
    spo2 = F.when(day % 5 != 0, F.struct((100 - F.col("w") / 3).alias("min_pct"), (F.col("v") * 2).alias("pct_time_below_90")))
    return n.select(
        F.col("day").alias("night"), F.col("w").alias("ahi"), F.col("v").alias("usage_hours"), (F.col("v") + 4).alias("median_epap"), spo2.alias("spo2"),
        F.struct((F.col("v") * 7 - F.col("w")).alias("rmssd_ms")).alias("hrv"), (90 - F.col("w") / 2).alias("efficiency_pct"), (F.col("v") * 5 + F.col("w")).alias("readiness_score"),
        F.when(day % 5 == 0, F.array(F.lit("spo2"))).otherwise(F.array().cast("array<string>")).alias("insufficient"), F.lit("inferred").alias("window_source"),
    )


@query("T24_engine_pairs")
def _(spark, sf):
    out = engine.run_engine(_engine_nights(spark, sf))["pairs"]
    return rounded(out.select("pair_id", "rho", "n", "n_eff", "p_method", "p_value", "p_value_adj", "q_value", "survives", "effect", F.concat_ws(",", "flags").alias("flags")))


@query("T23_group_contrasts")
def _(spark, sf):
    return rounded(engine.run_engine(_engine_nights(spark, sf))["group_tests"])


@query("T23_contrast_tests", f"WITH {NIGHTS}, e AS (SELECT v * 7 - w AS hrv, v * 5 + w AS ready, v, w FROM nights WHERE w IS NOT NULL), "
       + mann_whitney_sql("SELECT 'hrv-by-ahi' AS contrast, hrv AS v, (w - 25) * 4 + 10 >= 15 AS g FROM e WHERE (w - 25) * 4 + 10 >= 15 OR (w - 25) * 4 + 10 < 5 UNION ALL SELECT 'readiness-by-use', ready, v >= 4 FROM e", "contrast")
       + f""" SELECT contrast, 'primary' AS family, n1, n2, {r('CASE WHEN n1 > 0 AND n2 > 0 THEN least(u1, u2) END', 'u')}, {r('CASE WHEN n1 > 0 AND n2 > 0 THEN zz END', 'z')}, {r('CASE WHEN n1 > 0 AND n2 > 0 THEN pp END', 'p')},
 {r('CASE WHEN n1 > 0 AND n2 > 0 THEN 2 * cl - 1 END', 'effect')}, {r('CASE WHEN n1 > 0 AND n2 > 0 THEN 2 * greatest(0, ce - ha) - 1 END', 'effect_low')}, {r('CASE WHEN n1 > 0 AND n2 > 0 THEN 2 * least(1, ce + ha) - 1 END', 'effect_high')} FROM mw""")  # fmt: skip
def _(spark, sf):
    # spread so that there are nights on either side of both thresholds
    spread = _engine_nights(spark, sf).withColumn("ahi", (F.col("ahi") - 25) * 4 + 10)
    return rounded(engine.group_contrasts(spread).select("contrast", "family", "n1", "n2", "u", "z", "p", "effect", "effect_low", "effect_high"))


@query("T20_coverage_selection", f"WITH {NIGHTS}, n AS (SELECT w, date_diff('day', DATE '1990-01-01', day) % 5 <> 0 AS kept FROM nights WHERE w IS NOT NULL), "
       + mann_whitney_sql("SELECT pair_id, w AS v, kept OR pair_id NOT IN (1, 2, 8) AS g FROM n, (SELECT CAST(unnest([1, 2, 3, 7, 8, 9, 10]) AS BIGINT) AS pair_id) ids", "pair_id")
       + f""", m AS (SELECT pair_id, quantile_cont(v, 0.5) FILTER (g) AS a, quantile_cont(v, 0.5) FILTER (NOT g) AS b FROM s GROUP BY 1)
SELECT pair_id, n1 AS n_kept, n2 AS n_dropped, {r('a', 'kept_ahi')}, {r('b', 'dropped_ahi')}, {r('CASE WHEN n1 > 0 AND n2 > 0 THEN pp END', 'selection_p')} FROM mw JOIN m USING (pair_id)""")  # fmt: skip
def _(spark, sf):
    found = engine.coverage_selection(engine.pairs_long(_engine_nights(spark, sf)))
    return rounded(found.select("pair_id", "n_kept", "n_dropped", "kept_ahi", "dropped_ahi", "selection_p"))


_HERE = {"ahi": "w", "usage_hours": "v", "median_epap": "v + 4", "spo2.min_pct": "CASE WHEN e <> 0 THEN 100 - w / 3 END", "spo2.pct_time_below_90": "CASE WHEN e <> 0 THEN v * 2 END", "hrv.rmssd_ms": "v * 7 - w", "efficiency_pct": "90 - w / 2", "readiness_score": "v * 5 + w"}
_BOTH = [("ahi", "spo2.min_pct"), ("ahi", "spo2.pct_time_below_90"), ("ahi", "hrv.rmssd_ms"), ("ahi", "efficiency_pct"), ("median_epap", "spo2.min_pct"), ("usage_hours", "readiness_score"), ("usage_hours", "hrv.rmssd_ms")]
_MISSING = [("ahi", "hr.sleeping_avg"), ("ahi", "rr_nightly"), ("ahi", "snore.snore_minutes"), ("leak_median", "efficiency_pct"), ("ahi", "stress_score")]
_RANK = "rank() OVER (PARTITION BY x, y ORDER BY {0}) + (count(*) OVER (PARTITION BY x, y, {0}) - 1) / 2.0"


@query("T26_pair_matrix", f"""WITH {NIGHTS}, n AS (SELECT v, w, date_diff('day', DATE '1990-01-01', day) % 5 AS e FROM nights WHERE w IS NOT NULL),
l AS ({' UNION ALL '.join(f"SELECT '{x}' AS x, '{y}' AS y, {_HERE[x]} AS a, {_HERE[y]} AS b FROM n" for x, y in _BOTH)}),
k AS (SELECT x, y, {_RANK.format('a')} AS ra, {_RANK.format('b')} AS rb FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
p AS (SELECT x, y, {r('corr(ra, rb)', 'rho')} FROM k GROUP BY 1, 2 UNION ALL SELECT * FROM (VALUES {', '.join(f"('{x}', '{y}', CAST(NULL AS DOUBLE))" for x, y in _MISSING)}) t(x, y, rho))
SELECT x, y, rho FROM p UNION ALL SELECT y, x, rho FROM p UNION ALL SELECT x, x, 1.0 FROM (SELECT x FROM p UNION SELECT y FROM p)""")  # fmt: skip
def _(spark, sf):
    rho = inference.spearman(engine.pairs_long(_engine_nights(spark, sf)), "x_value", "y_value", ["pair_id"]).withColumnRenamed("r", "rho")
    found = engine.registry(spark).join(rho, "pair_id", "left").withColumn("p_value_adj", F.lit(None).cast("double"))
    return rounded(engine.pair_matrix(found).select("x", "y", "rho"))
