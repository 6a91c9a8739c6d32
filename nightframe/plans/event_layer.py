"""Queries of the event layer. Gaps are hours here: the subjects of the test log have an event every few hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe import params as P
from nightframe.functions import exprs as X
from nightframe.operators import events as E
from nightframe.operators import explorer
from nightframe.plans.frames import APNEA, EVENTS, NIGHTS, apneas, flow, log, nights
from nightframe.plans.nightly import r, rounded
from nightframe.plans.source_layer import scratch
from nightframe.streaming import sessions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

HOUR = 3600.0
BY = ["user_id"]
PARAMS = P.ClusterParams(gap=4 * HOUR, bridge_gap=8 * HOUR, bridge_threshold=0.3, edge_enter=0.6, edge_exit=0.4, edge_min=HOUR, min_events=2, min_total=60.0, max_span=24 * HOUR)
FN = P.FalseNegativeParams(threshold=0.3, peak=0.8, min_span=HOUR, max_span=48 * HOUR, gap=12 * HOUR)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("S04_scan_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'click', 'purchase') OR (event_type = 'view' AND value >= 10)")
def _(spark, sf):
    return E.scan_filter(log(spark, sf), "event_type", "value", APNEA, "view", 10).select("event_id", "event_type")


@query("S05_epoch_millis", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def _(spark, sf):
    return log(spark, sf).select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


GAP = f"""{EVENTS}, g AS (SELECT *, CASE WHEN t - lag(t + dur) OVER w <= {4 * HOUR} THEN 0 ELSE 1 END AS new FROM apneas WINDOW w AS (PARTITION BY user_id ORDER BY t, dur)),
assigned AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, dur ROWS UNBOUNDED PRECEDING) AS cluster FROM g)"""
SUMMARY = f"""count(*) AS count, {r('min(t)', 'start')}, {r('max(t + dur)', '"end"')}, {r('sum(dur)', 'total_sec')}, {r('max(t + dur) - min(t)', 'span_sec')},
 {r('count(*) / (greatest(max(t + dur) - min(t), 1) / 60)', 'density')}, {r('sum(dur) / (greatest(max(t + dur) - min(t), 1) / 60)', 'weighted_density')}"""  # fmt: skip


@query("W12_gap_clusters", f"WITH {GAP} SELECT user_id, CAST(cluster AS BIGINT) AS cluster, {SUMMARY} FROM assigned GROUP BY 1, 2")
def _(spark, sf):
    return rounded(E.clusters(apneas(spark, sf), flow(spark, sf), P.ClusterParams("agglomerative", gap=4 * HOUR), BY))


# the bridge as a correlated search rather than a running maximum
BRIDGE = f"""{EVENTS}, g AS (SELECT *, lag(t + dur) OVER w AS e, row_number() OVER w AS k FROM apneas WINDOW w AS (PARTITION BY user_id ORDER BY t, dur)),
h AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS far FROM g),
n AS (SELECT h.*, CASE WHEN e IS NULL THEN 1 WHEN t - e <= {4 * HOUR} THEN 0 WHEN t - e <= {8 * HOUR} AND EXISTS
 (SELECT 1 FROM flow f WHERE f.user_id = h.user_id AND f.level >= 0.3 AND f.t BETWEEN h.far AND h.t) THEN 0 ELSE 1 END AS new FROM h),
assigned AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k) AS cluster FROM n)"""


@query("J08_bridged_groups", f"WITH {BRIDGE} SELECT user_id, CAST(cluster AS BIGINT) AS cluster, {SUMMARY} FROM assigned GROUP BY 1, 2")
def _(spark, sf):
    return rounded(E.summarize_clusters(E.bridged_clusters(apneas(spark, sf), flow(spark, sf), PARAMS, BY), BY))


SEGMENTS = f"""i AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {8 * HOUR} AND level >= 0.4 THEN 0 ELSE 1 END AS new FROM flow WINDOW w AS (PARTITION BY user_id ORDER BY t, level)),
j AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, level ROWS UNBOUNDED PRECEDING) AS isl FROM i),
first_in AS (SELECT user_id, isl, min(t) FILTER (level >= 0.6) AS t0 FROM j GROUP BY 1, 2),
seg AS (SELECT j.user_id, j.isl, min(t) AS a, max(t) AS z FROM j JOIN first_in f ON f.user_id = j.user_id AND f.isl = j.isl AND j.t >= f.t0 GROUP BY 1, 2 HAVING max(t) - min(t) >= {HOUR})"""


@query("W14_flow_segments", f"WITH {EVENTS}, {SEGMENTS} SELECT user_id, {r('a', 'seg_start')}, {r('z', 'seg_end')} FROM seg")
def _(spark, sf):
    return rounded(E.flow_segments(flow(spark, sf), PARAMS, BY))


EXTENDED = f"""{BRIDGE}, {SEGMENTS},
c AS (SELECT user_id, cluster, min(t) AS s, max(t + dur) AS e, count(*) AS n, sum(dur) AS total FROM assigned GROUP BY 1, 2),
x AS (SELECT c.*, coalesce((SELECT min(a) FROM seg WHERE seg.user_id = c.user_id AND z <= s AND s - z <= {4 * HOUR}), s) AS s2,
 greatest(e, coalesce((SELECT arg_min(z, a) FROM seg WHERE seg.user_id = c.user_id AND a >= e AND a - e <= {4 * HOUR}), e)) AS e2 FROM c)"""


@query("W13_bridged_clusters", f"""WITH {EXTENDED} SELECT user_id, CAST(cluster AS BIGINT) AS cluster, n AS count, {r('s2', 'start')}, {r('e2', '"end"')}, {r('total', 'total_sec')},
 {r('e2 - s2', 'span_sec')}, {r('n / (greatest(e2 - s2, 1) / 60)', 'density')}, {r('total / (greatest(e2 - s2, 1) / 60)', 'weighted_density')}, {r('s', 'core_start')}, {r('e', 'core_end')} FROM x""")  # fmt: skip
def _(spark, sf):
    return rounded(E.clusters(apneas(spark, sf), flow(spark, sf), PARAMS, BY))


@query("F09_finalized", f"""WITH {EXTENDED} SELECT user_id, CAST(cluster AS BIGINT) AS cluster, {r('1.5 * total / 60 + 0.5 * n / (greatest(e2 - s2, 1) / 60) + ((s - s2) + (e2 - e)) / 30', 'severity')}
 FROM x WHERE n >= 2 AND total >= 60 AND e2 - s2 <= {24 * HOUR}""")  # fmt: skip
def _(spark, sf):
    return rounded(E.finalize(E.clusters(apneas(spark, sf), flow(spark, sf), PARAMS, BY), PARAMS).select("user_id", "cluster", "severity"))


@query("F10_dense_clusters", f"WITH {GAP}, c AS (SELECT user_id, cluster, count(*) / (greatest(max(t + dur) - min(t), 1) / 60) AS d FROM assigned GROUP BY 1, 2) SELECT user_id, CAST(cluster AS BIGINT) AS cluster, {r('d', 'density')} FROM c WHERE d >= 0.5")
def _(spark, sf):
    found = E.clusters(apneas(spark, sf), flow(spark, sf), P.ClusterParams("agglomerative", gap=4 * HOUR, min_density=0.5), BY)
    return rounded(found.select("user_id", "cluster", "density"))


RUNS = f"""{EVENTS}, q AS (SELECT * FROM flow WHERE level >= 0.3), k AS (SELECT *, CASE WHEN t - lag(t) OVER w > {12 * HOUR} THEN 1 WHEN lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new
 FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t, level)), l AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, level ROWS UNBOUNDED PRECEDING) AS id FROM k),
runs AS (SELECT user_id, id, min(t) AS a, max(t) AS z, max(level) AS peak FROM l GROUP BY 1, 2)"""


@query("W15_flow_runs", f"WITH {RUNS} SELECT user_id, {r('a', 'start')}, {r('z', '\"end\"')}, {r('peak', 'peak')}, {r('z - a', 'span_sec')} FROM runs WHERE z - a BETWEEN {HOUR} AND {48 * HOUR} AND peak >= 0.8")
def _(spark, sf):
    none = apneas(spark, sf).filter("false")
    return rounded(E.false_negatives(flow(spark, sf), none, FN, BY))


@query("T13_false_negatives", f"""WITH {RUNS} SELECT user_id, {r('a', 'start')}, {r('z', '"end"')}, {r('peak', 'peak')}, {r('z - a', 'span_sec')} FROM runs WHERE z - a BETWEEN {HOUR} AND {48 * HOUR} AND peak >= 0.8
 AND NOT EXISTS (SELECT 1 FROM apneas p WHERE p.user_id = runs.user_id AND p.t BETWEEN a - 5 AND z + 5)""")  # fmt: skip
def _(spark, sf):
    return rounded(E.false_negatives(flow(spark, sf), apneas(spark, sf), FN, BY))


@query("J11_range_stats", f"WITH {GAP}, c AS (SELECT user_id, cluster, min(t) AS s, max(t + dur) AS e FROM assigned GROUP BY 1, 2) SELECT c.user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, {r('min(level)', 'lo')}, {r('max(level)', 'hi')} FROM c JOIN flow f ON f.user_id = c.user_id AND f.t BETWEEN s - 30 AND e + 30 GROUP BY 1, 2")
def _(spark, sf):
    found = E.clusters(apneas(spark, sf), flow(spark, sf), P.ClusterParams("agglomerative", gap=4 * HOUR), BY).select("user_id", "cluster", "start", "end")
    return rounded(E.range_stats(found, flow(spark, sf), ["user_id", "cluster"], "level", BY, 30.0))


@query("J07_quiet_views", f"WITH {EVENTS} SELECT user_id, {r('t', 't')} FROM flow f WHERE NOT EXISTS (SELECT 1 FROM apneas p WHERE p.user_id = f.user_id AND p.t BETWEEN f.t - 3600 AND f.t + 3600)")
def _(spark, sf):
    points = flow(spark, sf).select("user_id", F.col("t").alias("start"), F.col("t").alias("end"))
    return rounded(E.without_events(points, apneas(spark, sf), HOUR, BY).select("user_id", F.col("start").alias("t")))


@query("O02_worst_clusters", f"""WITH {GAP}, c AS (SELECT user_id, cluster, 1.5 * sum(dur) / 60 + 0.5 * count(*) / (greatest(max(t + dur) - min(t), 1) / 60) AS s, count(*) n, sum(dur) d FROM assigned GROUP BY 1, 2)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, {r('s', 'severity')} FROM c WHERE n >= 3 AND d >= 60 ORDER BY s DESC, user_id, cluster LIMIT 20""")  # fmt: skip
def _(spark, sf):
    p = P.ClusterParams("agglomerative", gap=4 * HOUR, max_span=1e12)
    found = E.finalize(E.clusters(apneas(spark, sf), flow(spark, sf), p, BY), p)
    return rounded(found.orderBy(F.desc("severity"), "user_id", "cluster").limit(20).select("user_id", "cluster", "severity"))


@query("O03_bad_nights", f"""WITH {GAP}, c AS (SELECT user_id, cluster, min(t) AS s, 1.5 * sum(dur) / 60 + 0.5 * count(*) / (greatest(max(t + dur) - min(t), 1) / 60) AS sv FROM assigned GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(dur) >= 60 AND max(t + dur) - min(t) <= {24 * HOUR}),
d AS (SELECT make_timestamp(CAST(s * 1e6 AS BIGINT))::DATE AS day, max(sv) AS worst FROM c GROUP BY 1), n AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1)
SELECT n.day, {r('v', 'ahi')}, {r('worst', 'worst')} FROM n LEFT JOIN d ON n.day = d.day WHERE v >= 1 ORDER BY n.day LIMIT 10""")  # fmt: skip
def _(spark, sf):
    gap = P.ClusterParams("agglomerative", gap=4 * HOUR)
    found = E.finalize(E.clusters(apneas(spark, sf), flow(spark, sf), gap, BY), PARAMS)
    means = log(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return rounded(E.bad_nights(means, "day", "v", found, 1.0))


@query("F11_normalized", """WITH x AS (SELECT event_id, event_id % 3 AS k, ts FROM events) SELECT event_id, date_trunc('millisecond', ts) AS start, date_trunc('millisecond', CASE WHEN k = 1 THEN ts + INTERVAL 1 HOUR ELSE ts END) AS "end" FROM x WHERE k <> 2""")
def _(spark, sf):
    x, k, ts = log(spark, sf), F.col("event_id") % 3, F.col("ts").cast("timestamp")
    found = x.select("event_id", F.when(k != 2, F.unix_millis(ts)).alias("start"), F.when(k == 1, F.date_format(ts + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("none").alias("end"))
    out = E.normalize_intervals(found)
    return out.select("event_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")])


@query("J03_event_nights", f"""WITH {GAP}, c AS (SELECT user_id, cluster, min(t) AS s, 1.5 * sum(dur) / 60 + 0.5 * count(*) / (greatest(max(t + dur) - min(t), 1) / 60) AS sv FROM assigned GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(dur) >= 60),
d AS (SELECT make_timestamp(CAST(s * 1e6 AS BIGINT))::DATE AS day, max(sv) AS worst FROM c GROUP BY 1), n AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1)
SELECT n.day, {r('v', 'ahi')}, {r('worst', 'worst')} FROM n LEFT JOIN d ON n.day = d.day WHERE v >= 1""")  # fmt: skip
def _(spark, sf):
    p = P.ClusterParams("agglomerative", gap=4 * HOUR, max_span=1e12)
    found = E.finalize(E.clusters(apneas(spark, sf), flow(spark, sf), p, BY), p)
    by_day = log(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return rounded(E.bad_nights(by_day, "day", "v", found, 1.0, None))


# The whole log as one subject, cut into slices of time, none of which sees all of it.
MIN = 60.0
LOG = P.ClusterParams(gap=20 * MIN, bridge_gap=40 * MIN, bridge_threshold=0.3, edge_enter=0.6, edge_exit=0.4, edge_min=10 * MIN)
LOG_FN = P.FalseNegativeParams(threshold=0.3, peak=0.8, min_span=10 * MIN, max_span=12 * HOUR, gap=45 * MIN)
LOG_GAP = f"""{EVENTS}, g AS (SELECT t, dur, CASE WHEN t - lag(t + dur) OVER w <= {20 * MIN} THEN 0 ELSE 1 END AS new FROM apneas WINDOW w AS (ORDER BY t, dur)),
assigned AS (SELECT *, sum(new) OVER (ORDER BY t, dur ROWS UNBOUNDED PRECEDING) AS cluster FROM g)"""


def arriving(spark, sf: str, chunks: list[str]) -> str:
    """A folder that the events come to as files, one stretch of time after the other, and last two rows from far ahead that
    let the watermark pass all events. They belong to no user of the log."""
    folder, x = scratch(spark), log(spark, sf).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    ends = [None, *chunks, None]
    for begin, end in zip(ends, ends[1:], strict=False):
        inside = F.lit(True) if begin is None else F.col("ts") >= F.lit(begin).cast("timestamp")
        inside &= F.lit(True) if end is None else F.col("ts") < F.lit(end).cast("timestamp")
        x.filter(inside).write.mode("append").parquet(folder)
    for year in (2100, 2101):
        end = spark.range(1).select(F.lit(-1).cast("bigint").alias("user_id"), F.lit(APNEA[0]).alias("event_type"), F.lit(f"{year}-01-01").cast("timestamp").alias("ts"), F.lit(0.0).alias("value"))
        end.write.mode("append").parquet(folder)
    return folder


@query("W12_stream_clusters", f"WITH {GAP} SELECT user_id, CAST(cluster AS BIGINT) AS cluster, {r('min(t)', 'start')}, {r('max(t + dur)', '"end"')}, count(*) AS count, {r('sum(dur)', 'total_sec')} FROM assigned GROUP BY 1, 2")
def _(spark, sf):
    """As W12_gap_clusters, from a stream with state for each user."""
    folder, out = arriving(spark, sf, ["2024-01-11", "2024-01-21"]), scratch(spark)
    events = sessions.read_events(spark, folder, "user_id bigint, event_type string, ts timestamp, value double")
    found = sessions.stream_clusters(events.filter(F.col("event_type").isin(*APNEA)), "ts", "value", BY, 4 * HOUR, "15 days")
    sessions.run_through(found, out, scratch(spark))
    return rounded(spark.read.parquet(out).filter("user_id >= 0"))


@query("W12_log_clusters", f"WITH {LOG_GAP} SELECT CAST(cluster AS BIGINT) AS cluster, {SUMMARY} FROM assigned GROUP BY 1")
def _(spark, sf):
    whole = apneas(spark, sf).drop("user_id")
    return rounded(E.clusters(whole, flow(spark, sf).drop("user_id"), P.ClusterParams("agglomerative", gap=20 * MIN)))


LOG_BRIDGE = f"""{EVENTS}, g AS (SELECT t, dur, lag(t + dur) OVER w AS e, row_number() OVER w AS k FROM apneas WINDOW w AS (ORDER BY t, dur)),
h AS (SELECT *, max(e) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS far FROM g),
n AS (SELECT h.*, CASE WHEN e IS NULL THEN 1 WHEN t - e <= {20 * MIN} THEN 0
 WHEN t - e <= {40 * MIN} AND (SELECT max(f.t) FROM flow f WHERE f.level >= 0.3 AND f.t <= h.t) >= far THEN 0 ELSE 1 END AS new FROM h),
assigned AS (SELECT *, sum(new) OVER (ORDER BY k) AS cluster FROM n),
i AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {40 * MIN} AND level >= 0.4 THEN 0 ELSE 1 END AS new FROM flow WINDOW w AS (ORDER BY t, level)),
j AS (SELECT *, sum(new) OVER (ORDER BY t, level ROWS UNBOUNDED PRECEDING) AS isl FROM i),
first_in AS (SELECT isl, min(t) FILTER (level >= 0.6) AS t0 FROM j GROUP BY 1),
seg AS (SELECT j.isl, min(t) AS a, max(t) AS z FROM j JOIN first_in f ON f.isl = j.isl AND j.t >= f.t0 GROUP BY 1 HAVING max(t) - min(t) >= {10 * MIN}),
c AS (SELECT cluster, min(t) AS s, max(t + dur) AS e, count(*) AS n, sum(dur) AS total FROM assigned GROUP BY 1),
x AS (SELECT c.*, coalesce((SELECT min(a) FROM seg WHERE z <= s AND s - z <= {20 * MIN}), s) AS s2,
 greatest(e, coalesce((SELECT arg_min(z, a) FROM seg WHERE a >= e AND a - e <= {20 * MIN}), e)) AS e2 FROM c)"""


@query("W13_log_clusters", f"""WITH {LOG_BRIDGE} SELECT CAST(cluster AS BIGINT) AS cluster, n AS count, {r('s2', 'start')}, {r('e2', '"end"')}, {r('total', 'total_sec')},
 {r('e2 - s2', 'span_sec')}, {r('n / (greatest(e2 - s2, 1) / 60)', 'density')}, {r('total / (greatest(e2 - s2, 1) / 60)', 'weighted_density')}, {r('s', 'core_start')}, {r('e', 'core_end')} FROM x""")  # fmt: skip
def _(spark, sf):
    return rounded(E.clusters(apneas(spark, sf).drop("user_id"), flow(spark, sf).drop("user_id"), LOG))


LOG_RUNS = f"""{EVENTS}, q AS (SELECT * FROM flow WHERE level >= 0.3), k AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {45 * MIN} THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (ORDER BY t, level)),
l AS (SELECT *, sum(new) OVER (ORDER BY t, level ROWS UNBOUNDED PRECEDING) AS id FROM k), runs AS (SELECT id, min(t) AS a, max(t) AS z, max(level) AS peak FROM l GROUP BY 1)"""


@query("W15_log_runs", f"WITH {LOG_RUNS} SELECT {r('a', 'start')}, {r('z', '\"end\"')}, {r('peak', 'peak')}, {r('z - a', 'span_sec')} FROM runs WHERE z - a BETWEEN {10 * MIN} AND {12 * HOUR} AND peak >= 0.8")
def _(spark, sf):
    none = apneas(spark, sf).drop("user_id").filter("false")
    return rounded(E.false_negatives(flow(spark, sf).drop("user_id"), none, LOG_FN))


# the best of all partitions of each user's distinct starts into four runs at most, by layers of prefix sums
KMEANS = f"""{EVENTS}, d AS (SELECT user_id, t, count(*)::DOUBLE AS c FROM apneas GROUP BY 1, 2), z AS (SELECT user_id, t, c, t - min(t) OVER (PARTITION BY user_id) AS u FROM d),
p AS (SELECT user_id, list_prepend(0.0::DOUBLE, list(a ORDER BY t)) AS n, list_prepend(0.0::DOUBLE, list(b ORDER BY t)) AS s, list_prepend(0.0::DOUBLE, list(e ORDER BY t)) AS q, list(t ORDER BY t) AS ts, count(*) AS m
 FROM (SELECT user_id, t, sum(c) OVER w AS a, sum(c * u) OVER w AS b, sum(c * u * u) OVER w AS e FROM z WINDOW w AS (PARTITION BY user_id ORDER BY t)) GROUP BY 1),
y AS (SELECT user_id, CAST(0 AS BIGINT) AS j, [CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 1e300::DOUBLE END FOR i IN range(0, m + 1)] AS best, CAST([] AS BIGINT[][]) AS origins FROM p
 UNION ALL SELECT user_id, j + 1, [w.cost FOR w IN ways], list_append(origins, [w.l FOR w IN ways]) FROM (SELECT y.user_id, j, origins,
 [CASE WHEN i = 0 THEN {{'cost': 1e300::DOUBLE, 'l': CAST(0 AS BIGINT)}} ELSE list_min([{{'cost': best[l + 1] + (q[i + 1] - q[l + 1] - (s[i + 1] - s[l + 1]) * (s[i + 1] - s[l + 1]) / (n[i + 1] - n[l + 1])), 'l': l}} FOR l IN range(0, i)]) END FOR i IN range(0, m + 1)] AS ways
 FROM y JOIN p ON p.user_id = y.user_id WHERE j < least(4, m)) o),
f AS (SELECT y.user_id, origins, m, ts, j FROM y JOIN p ON p.user_id = y.user_id WHERE j = least(4, m)),
b AS (SELECT user_id, j, m AS upto, origins[j][m + 1] AS l FROM f UNION ALL SELECT b.user_id, b.j - 1, b.l, f.origins[b.j - 1][b.l + 1] FROM b JOIN f ON f.user_id = b.user_id WHERE b.j > 1),
runs AS (SELECT b.user_id, b.j AS cluster, ts[l + 1] AS lo, ts[upto] AS hi FROM b JOIN f ON f.user_id = b.user_id),
assigned AS (SELECT a.*, cluster FROM apneas a JOIN runs ON runs.user_id = a.user_id AND t BETWEEN lo AND hi)"""


@query("T11_kmeans", f"WITH RECURSIVE {KMEANS} SELECT user_id, CAST(cluster AS BIGINT) AS cluster, {SUMMARY} FROM assigned GROUP BY 1, 2")
def _(spark, sf):
    return rounded(E.clusters(apneas(spark, sf), flow(spark, sf), P.ClusterParams("kmeans", k=4), BY))


@query("S44_cluster_csv", f"WITH {GAP} SELECT user_id || ',' || CAST(CAST(cluster AS BIGINT) AS VARCHAR) || ',' || count(*) AS line FROM assigned GROUP BY user_id, cluster")
def _(spark, sf):
    found = E.clusters(apneas(spark, sf), flow(spark, sf), P.ClusterParams("agglomerative", gap=4 * HOUR), BY)
    return explorer.csv_lines(found.select("user_id", "cluster", "count"))


@query("X07_severity", f"""SELECT event_id, {r("1.5 * value / 60 + 0.5 * (1 / (greatest(value, 1) / 60)) + 2", 'severity')} FROM events""")
def _(spark, sf):
    v = F.col("value")
    return log(spark, sf).select("event_id", X.r6(X.cluster_severity(v, X.density(F.lit(1), v), F.lit(60.0))).alias("severity"))
