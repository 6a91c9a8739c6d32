"""Queries of the nightly layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe.functions import exprs as X
from nightframe.operators import descriptive as D
from nightframe.operators import explorer as E
from nightframe.operators import kernels as K
from nightframe.operators import series as S
from nightframe.plans.frames import NIGHTS, log, nights, shipped, table, usage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df):
    """Doubles to six decimals, whole numbers to longs."""
    kinds = {"double": X.r6, "int": lambda c: F.col(c).cast("long")}
    return df.select(*[kinds[k](c).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes])


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


Q3 = ", ".join(r(f"quantile_cont(v, {q})", n) for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")))


@query("A01_quantiles", f"""SELECT event_type, count(value) AS n, {r('quantile_cont(value, 0.25)', 'p25')}, {r('quantile_cont(value, 0.5)', 'median')},
 {r('quantile_cont(value, 0.95)', 'p95')} FROM events GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return rounded(D.quantiles(log(spark, sf), "value", {"p25": 0.25, "median": 0.5, "p95": 0.95}, ["event_type"], spread=True))


@query("A02_usage_summary", f"""WITH {NIGHTS}, q AS (SELECT quantile_cont(v, 0.25) a, quantile_cont(v, 0.5) b, quantile_cont(v, 0.75) c FROM nights)
SELECT count(*) AS total_nights, count(v) AS valid_nights, count(*) - count(v) AS invalid_nights,
 count(*) FILTER (v >= 4) AS nights_long, count(*) FILTER (v >= 6) AS nights_long6, count(*) FILTER (v < 4) AS nights_short,
 {r('avg(v)', 'avg_hours')}, {r('min(v)', 'min_hours')}, {r('max(v)', 'max_hours')}, {r('any_value(b)', 'median_hours')},
 {r('any_value(a)', 'p25_hours')}, {r('any_value(c)', 'p75_hours')}, {r('any_value(c - a)', 'iqr_hours')},
 count(*) FILTER (v < a - 1.5 * (c - a)) AS outlier_low, count(*) FILTER (v > c + 1.5 * (c - a)) AS outlier_high FROM nights, q""")  # fmt: skip
def _(spark, sf):
    return rounded(D.usage_summary(nights(spark, sf), "v"))


@query("A03_ahi_trends", f"""WITH {NIGHTS}, o AS (SELECT v, row_number() OVER (ORDER BY day) a, row_number() OVER (ORDER BY day DESC) z FROM nights)
SELECT {r('avg(v)', 'avg_ahi')}, {r('min(v)', 'min_ahi')}, {r('max(v)', 'max_ahi')}, {r('quantile_cont(v, 0.25)', 'p25_ahi')},
 {r('quantile_cont(v, 0.5)', 'median_ahi')}, {r('quantile_cont(v, 0.75)', 'p75_ahi')}, {r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', 'iqr_ahi')},
 count(*) FILTER (v > 5) AS nights_over5, {r('avg(v) FILTER (a <= 30)', 'first30_ahi')}, {r('avg(v) FILTER (z <= 30)', 'last30_ahi')} FROM o""")  # fmt: skip
def _(spark, sf):
    return rounded(D.ahi_trends(nights(spark, sf), "day", "v"))


@query("A04_epap_trends", f"""WITH {NIGHTS}, o AS (SELECT v, w / 4 AS e, row_number() OVER (ORDER BY day) a, row_number() OVER (ORDER BY day DESC) z FROM nights)
SELECT {r('min(e)', 'min_epap')}, {r('max(e)', 'max_epap')}, {r('quantile_cont(e, 0.25)', 'p25_epap')}, {r('quantile_cont(e, 0.5)', 'median_epap')},
 {r('quantile_cont(e, 0.75)', 'p75_epap')}, {r('quantile_cont(e, 0.75) - quantile_cont(e, 0.25)', 'iqr_epap')},
 {r('avg(v) FILTER (e < 7)', 'avg_ahi_low')}, {r('avg(v) FILTER (e >= 7)', 'avg_ahi_high')},
 count(v) FILTER (e < 7) AS n_low, count(v) FILTER (e >= 7) AS n_high,
 {r('avg(e) FILTER (a <= 30)', 'first30_epap')}, {r('avg(e) FILTER (z <= 30)', 'last30_epap')}, {r('corr(e, v)', 'corr_epap_ahi')} FROM o""")  # fmt: skip
def _(spark, sf):
    return rounded(D.epap_trends(nights(spark, sf).withColumn("e", F.col("w") / 4), "day", "e", "v"))


@query("A05_event_stats", f"""WITH x AS (SELECT ts, value AS v FROM events WHERE event_type <> 'signup'),
q AS (SELECT quantile_cont(v, 0.25) a, quantile_cont(v, 0.75) c FROM x),
nn AS (SELECT CAST(ts AS DATE) d, count(*) k FROM x GROUP BY 1), nq AS (SELECT quantile_cont(k, 0.25) na, quantile_cont(k, 0.5) nb, quantile_cont(k, 0.75) nc FROM nn),
night AS (SELECT count(*) AS nights, {r('any_value(nb)', 'median_per_night')}, {r('any_value(na)', 'p25_per_night')}, {r('any_value(nc)', 'p75_per_night')},
 CAST(min(k) AS DOUBLE) AS min_per_night, CAST(max(k) AS DOUBLE) AS max_per_night,
 count(*) FILTER (k >= nc + 1.5 * (nc - na)) AS outlier_nights_high, count(*) FILTER (k <= na - 1.5 * (nc - na)) AS outlier_nights_low FROM nn, nq)
SELECT e.*, night.* FROM (SELECT count(v) AS total_events, {r('avg(v)', 'avg_sec')}, {r('min(v)', 'min_sec')}, {r('max(v)', 'max_sec')},
 {r('quantile_cont(v, 0.25)', 'p25_sec')}, {r('quantile_cont(v, 0.5)', 'median_sec')}, {r('quantile_cont(v, 0.75)', 'p75_sec')}, {r('quantile_cont(v, 0.95)', 'p95_sec')},
 count(*) FILTER (v > 30) AS over30, count(*) FILTER (v > 60) AS over60, count(*) FILTER (v >= c + 1.5 * (c - a)) AS outlier_events FROM x, q) e, night""")  # fmt: skip
def _(spark, sf):
    return rounded(D.event_stats(log(spark, sf).filter("event_type <> 'signup'"), "ts", "value"))


BAND = "CASE WHEN w <= 5 THEN 'normal' WHEN w <= 15 THEN 'mild' WHEN w <= 30 THEN 'moderate' ELSE 'severe' END"


@query("A06_severity_bands", f"WITH {NIGHTS} SELECT {BAND} AS band, count(*) AS nights FROM nights WHERE w IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return D.severity_bands(nights(spark, sf), "w")


@query("A07_kpis", f"""WITH {NIGHTS}, e AS (SELECT max(day) z FROM nights) SELECT {r('100.0 * count(*) FILTER (v >= 4) / count(v)', 'pct_4h')},
 {r('100.0 * count(*) FILTER (v >= 6) / count(v)', 'pct_6h')}, {r('100.0 * count(*) FILTER (v >= 4 AND day > z - 30) / count(v) FILTER (day > z - 30)', 'pct_4h_last30')}, count(v) AS nights FROM nights, e""")  # fmt: skip
def _(spark, sf):
    return rounded(D.kpis(nights(spark, sf), "day", "v"))


@query("A08_usage_stats", f"""WITH {NIGHTS}, s AS (SELECT count(v) n, avg(v) m, min(v) lo, max(v) hi, quantile_cont(v, 0.25) a, quantile_cont(v, 0.5) b, quantile_cont(v, 0.75) c FROM nights)
SELECT n, {r('m', 'mean')}, {r('a', 'p25')}, {r('b', 'median')}, {r('c', 'p75')}, {r('c - a', 'iqr')}, {r('hi - lo', 'range')},
 CAST(greatest(1, ceil((hi - lo) / (2 * (c - a) / pow(n, 1.0 / 3)))) AS BIGINT) AS nbins FROM s""")  # fmt: skip
def _(spark, sf):
    return rounded(D.usage_stats(nights(spark, sf), "v"))


@query("A09_histogram", f"""WITH {NIGHTS}, e AS (SELECT min(v) lo, max(v) hi FROM nights)
SELECT CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n, {r('any_value(lo)', 'lo')}, {r('any_value(hi)', 'hi')} FROM nights, e WHERE v IS NOT NULL GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return rounded(D.histogram(nights(spark, sf), "v", 20))


@query("A10_histogram2d", f"""WITH {NIGHTS}, b AS (SELECT v, w FROM nights WHERE v IS NOT NULL AND w IS NOT NULL), e AS (SELECT min(v) a, max(v) b, min(w) c, max(w) d FROM b)
SELECT CAST(least(floor((v - e.a) / (e.b - e.a) * 10), 9) AS BIGINT) AS bx, CAST(least(floor((w - e.c) / (e.d - e.c) * 10), 9) AS BIGINT) AS by, count(*) AS n FROM b, e GROUP BY 1, 2""")  # fmt: skip
def _(spark, sf):
    return D.histogram2d(nights(spark, sf), "v", "w", 10)


@query("A11_box", f"""SELECT o_orderpriority, count(o_totalprice) AS n, {r('min(o_totalprice)', 'lo')}, {r('quantile_cont(o_totalprice, 0.25)', 'p25')},
 {r('quantile_cont(o_totalprice, 0.5)', 'median')}, {r('quantile_cont(o_totalprice, 0.75)', 'p75')}, {r('max(o_totalprice)', 'hi')} FROM orders GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return rounded(D.box(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"], spread=True))


@query("A23_pivot", f"""SELECT coalesce(p_brand, '') AS "group", count(*) AS n, {r('avg(p_partkey)', 'mean_p_partkey')}, {r('avg(p_size)', 'mean_p_size')}, {r('avg(p_retailprice)', 'mean_p_retailprice')} FROM part GROUP BY 1""")
def _(spark, sf):
    return rounded(D.pivot(table(spark, sf, "part"), "p_brand"))


@query("A25_median_iqr", f"""SELECT c_mktsegment, count(c_acctbal) AS n, {r('quantile_cont(c_acctbal, 0.25)', 'p25')}, {r('quantile_cont(c_acctbal, 0.5)', 'median')}, {r('quantile_cont(c_acctbal, 0.75)', 'p75')},
 {r('quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)', 'iqr')} FROM customer GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return rounded(D.median_iqr(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"], spread=True))


@query("A28_report", f"""WITH {NIGHTS}, q AS (SELECT quantile_cont(w, 0.25) a, quantile_cont(w, 0.75) c FROM nights)
SELECT count(w) AS valid, count(*) FILTER (w >= c + 1.5 * (c - a)) AS outliers, {', '.join(r(f'100.0 * count(*) FILTER (w > {t}) / count(w)', f'pct_over{t}') for t in (5, 15, 30))} FROM nights, q""")  # fmt: skip
def _(spark, sf):
    return rounded(D.outlier_share(nights(spark, sf), "w"))


@query("A29_event_shares", f"SELECT count(value) AS n, {r('100.0 * count(*) FILTER (value > 30) / count(value)', 'pct_over30')}, {r('100.0 * count(*) FILTER (value > 60) / count(value)', 'pct_over60')} FROM events")
def _(spark, sf):
    return rounded(D.event_shares(log(spark, sf), "value"))


def rolling_sql(days: int) -> str:
    over = f"OVER (ORDER BY day RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING AND CURRENT ROW)"
    return f"""WITH {NIGHTS}, x AS (SELECT day, v, count(v) {over} n, avg(v) {over} m, stddev_samp(v) {over} sd, list(v) {over} l,
 count(v) FILTER (v >= 4) {over} c, quantile_cont(v, 0.5) {over} md FROM nights),
y AS (SELECT *, list_sort(l) s, greatest(0, floor(n * 0.5 - 1.96 * sqrt(n * 0.25))) lo, least(n - 1, ceil(n * 0.5 + 1.96 * sqrt(n * 0.25))) hi FROM x)
SELECT day, {r('v', 'value')}, n, {r('m', 'avg')}, {r('m - 1.96 * sd / sqrt(n)', 'avg_low')}, {r('m + 1.96 * sd / sqrt(n)', 'avg_high')}, {r('md', 'median')},
 {r('s[CAST(lo AS BIGINT) + 1]', 'median_low')}, {r('s[CAST(hi AS BIGINT) + 1]', 'median_high')}, {r('100.0 * c / n', 'pct_4h')} FROM y"""


@query("W01_rolling", rolling_sql(7))
def _(spark, sf):
    return rounded(S.rolling(nights(spark, sf), "day", "v", 7))


@query("W01_rolling_30", rolling_sql(30))
def _(spark, sf):
    return rounded(S.rolling(nights(spark, sf), "day", "v", 30))


@query("W02_streaks", f"""WITH {NIGHTS}, t AS (SELECT day, v, unnest([4.0, 5.0, 6.0])::DOUBLE AS threshold FROM nights), o AS (SELECT *, v >= threshold AS ok FROM t),
g AS (SELECT threshold, ok, row_number() OVER (PARTITION BY threshold ORDER BY day) - row_number() OVER (PARTITION BY threshold, ok ORDER BY day) AS run FROM o),
c AS (SELECT threshold, ok, run, count(*) AS k FROM g GROUP BY ALL) SELECT threshold, coalesce(max(k) FILTER (ok), 0) AS longest FROM c GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return S.streaks(nights(spark, sf), "day", "v", [4.0, 5.0, 6.0])


@query("W03_breakpoints", f"""WITH {NIGHTS}, x AS (SELECT day, avg(v) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)
 - avg(v) OVER (ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS d FROM nights),
y AS (SELECT *, lag(d) OVER (ORDER BY day) p FROM x) SELECT day, {r('d', 'delta')} FROM y WHERE sign(d) <> sign(p) AND abs(d) >= 0.1""")  # fmt: skip
def _(spark, sf):
    n = nights(spark, sf)
    short = S.rolling(n, "day", "v", 7).select("day", F.col("avg").alias("a7"))
    long = S.rolling(n, "day", "v", 30).select("day", F.col("avg").alias("a30"))
    return rounded(S.breakpoints(short.join(long, "day"), "day", "a7", "a30", 0.1))


# the same recurrence over lists, one night after the other
@query("W04_change_points", f"""WITH RECURSIVE {NIGHTS}, z AS (SELECT day, v, coalesce(v, 0) AS x FROM nights),
q AS (SELECT list_prepend(0.0::DOUBLE, list(a ORDER BY day)) AS s1, list_prepend(0.0::DOUBLE, list(b ORDER BY day)) AS s2, list(day ORDER BY day) AS days, list(v ORDER BY day) AS vs, count(*) AS n
 FROM (SELECT day, v, sum(x) OVER w AS a, sum(x * x) OVER w AS b FROM z WINDOW w AS (ORDER BY day))),
d AS (SELECT CAST(0 AS BIGINT) AS t, [-10.0::DOUBLE] AS best, [CAST(0 AS BIGINT)] AS origin FROM q
 UNION ALL SELECT t + 1, list_append(best, c.cost), list_append(origin, c.s) FROM (SELECT t, best, origin, list_min(list_transform(range(0, t + 1),
 lambda s: {{'cost': best[s + 1] + s2[t + 2] - s2[s + 1] - (s1[t + 2] - s1[s + 1]) * (s1[t + 2] - s1[s + 1]) / (t + 1 - s) + 10, 's': s}})) AS c FROM d, q WHERE t < n) y),
f AS (SELECT origin FROM d, q WHERE t = n), b AS (SELECT origin[n + 1] AS t, n AS upto FROM f, q UNION ALL SELECT origin[t + 1], t FROM b, f WHERE t > 0)
SELECT days[t + 1] AS day, {r('abs(list_avg(vs[t + 1 : upto]) - list_avg(vs[(SELECT origin[b.t + 1] FROM f) + 1 : t]))', 'shift')} FROM b, q WHERE t > 0""")  # fmt: skip
def _(spark, sf):
    return rounded(K.change_point_days(nights(spark, sf), "day", "v", 10.0))


@query("W05_decompose", f"""WITH {NIGHTS}, x AS (SELECT day, v, row_number() OVER (ORDER BY day) - 1 AS i, avg(v) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS t FROM nights),
p AS (SELECT i % 7 AS pl, avg(v - t) AS m FROM x GROUP BY 1), s AS (SELECT pl, m - avg(m) OVER () AS q FROM p)
SELECT day, {r('v', 'value')}, {r('t', 'trend')}, {r('q', 'seasonal')}, {r('v - t - q', 'residual')} FROM x JOIN s ON x.i % 7 = s.pl""")  # fmt: skip
def _(spark, sf):
    return rounded(S.decompose(nights(spark, sf), "day", "v"))


@query("W06_autocorrelation", f"""WITH {NIGHTS}, x AS (SELECT row_number() OVER (ORDER BY day) i, v - avg(v) OVER () AS c FROM nights), k AS (SELECT unnest(range(31)) AS lag),
t AS (SELECT sum(c * c) ss, count(*) n FROM x)
SELECT CAST(lag AS BIGINT) AS lag, {r('sum(a.c * b.c) / any_value(ss)', 'acf')}, count(*) AS pairs, {r('1.96 / sqrt(any_value(n))', 'conf')} FROM x a, k, x b, t WHERE b.i = a.i - lag GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return rounded(S.autocorrelation(nights(spark, sf), "day", "v", 30))


def _swept(p: int) -> str:
    """Takes the value ``p`` rows before out of all covariances, where it lies between the two ends."""
    at = lambda t, i, j: f"JOIN c{p - 1} {t} ON {t}.k = a.k AND {t}.i = {i} AND {t}.j = {j}"
    return f"c{p} AS MATERIALIZED (SELECT a.k, a.i, a.j, CASE WHEN a.k > {p} THEN a.v - b.v * c.v / d.v ELSE a.v END AS v FROM c{p - 1} a LEFT {at('b', 'a.i', p)} LEFT {at('c', p, 'a.j')} LEFT {at('d', p, p)})"


# by sweeping covariances, where the library takes residuals
@query("W07_partial_autocorrelation", f"""WITH {NIGHTS}, x AS (SELECT row_number() OVER (ORDER BY day) AS t, v FROM nights),
u AS (SELECT k, i, j FROM (SELECT unnest(range(1, 11)) AS k), (SELECT unnest(range(0, 11)) AS i), (SELECT unnest(range(0, 11)) AS j) WHERE i <= k AND j <= k),
c0 AS MATERIALIZED (SELECT k, i, j, covar_samp(a.v, b.v) AS v FROM u JOIN x o ON o.t > k JOIN x a ON a.t = o.t - i JOIN x b ON b.t = o.t - j GROUP BY 1, 2, 3), {', '.join(_swept(p) for p in range(1, 10))}
SELECT CAST(a.k AS BIGINT) AS lag, {r('a.v / sqrt(b.v * c.v)', 'pacf')}, false AS unstable FROM c9 a JOIN c9 b ON b.k = a.k AND b.i = 0 AND b.j = 0 JOIN c9 c ON c.k = a.k AND c.i = a.k AND c.j = a.k WHERE a.i = 0 AND a.j = a.k""")  # fmt: skip
def _(spark, sf):
    return rounded(K.partial_autocorrelations(nights(spark, sf), "day", "v", 10))


@query("W09_first_last", f"""WITH o AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) a, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) z FROM orders)
SELECT o_orderpriority, {r('avg(v) FILTER (a <= 30)', 'first_mean')}, {r('avg(v) FILTER (z <= 30)', 'last_mean')} FROM o GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return rounded(D.first_last(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", ["o_orderpriority"]))


@query("W10_ranks", f"""WITH x AS (SELECT p_partkey, p_brand, p_size FROM part) SELECT p_partkey, p_brand,
 CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS DOUBLE) AS rank FROM x""")  # fmt: skip
def _(spark, sf):
    return S.ranks(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"]).select("p_partkey", "p_brand", "rank")


A = [2.50662823884, -18.61500062529, 41.39119773534, -25.44106049637]
B = [-8.4735109309, 23.08336743743, -21.06224101826, 3.13082909833]
C = [0.3374754822726147, 0.9761690190917186, 0.1607979714918209, 0.0276438810333863, 0.0038405729373609, 0.0003951896511919, 0.0000321767881768, 0.0000002888167364, 0.0000003960315187]


def power_sum(c: list[float], x: str) -> str:
    return " + ".join(f"CAST({v!r} AS DOUBLE) * pow({x}, {i})" for i, v in enumerate(c)).replace("e-", "E-")


def quantile_sql(p: str) -> str:
    y = f"({p} - 0.5)"
    tail = f"({power_sum(C, f'ln(-ln(CASE WHEN {y} > 0 THEN 1 - {p} ELSE {p} END))')})"
    mid = f"{y} * ({power_sum(A, f'({y} * {y})')}) / (1 + {y} * {y} * ({power_sum(B, f'({y} * {y})')}))"
    return f"CASE WHEN abs({y}) < 0.42 THEN {mid} WHEN {y} < 0 THEN -{tail} ELSE {tail} END"


@query("W16_qq_points", f"""WITH {NIGHTS}, x AS (SELECT v, count(*) OVER () n, avg(v) OVER () m, stddev_samp(v) OVER () s, row_number() OVER (ORDER BY v) k FROM nights WHERE v IS NOT NULL)
SELECT k AS place, {r('v', 'value')}, {r(f"m + s * ({quantile_sql('(k / (n + 1.0)::DOUBLE)')})", 'theoretical')} FROM x""")  # fmt: skip
def _(spark, sf):
    return rounded(S.qq_points(nights(spark, sf), "v"))


@query("W17_survival", f"""WITH x AS (SELECT event_type, round(value) AS t, count(*) d FROM events WHERE value >= 0 GROUP BY 1, 2),
y AS (SELECT *, sum(d) OVER (PARTITION BY event_type) n, sum(d) OVER (PARTITION BY event_type ORDER BY t) cum FROM x), z AS (SELECT *, n - cum + d AS r, 1 - cum / n AS s FROM y),
g AS (SELECT *, sum(CASE WHEN r > d THEN d / (r * (r - d))::DOUBLE ELSE 0 END) OVER (PARTITION BY event_type ORDER BY t) AS gw FROM z)
SELECT event_type, t AS time, d, CAST(r AS BIGINT) AS at_risk, {r('s', 'survival')},
 {r('CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) + 1.96 * sqrt(gw) / abs(ln(s)))) END', 'lower')},
 {r('CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) - 1.96 * sqrt(gw) / abs(ln(s)))) END', 'upper')} FROM g""")  # fmt: skip
def _(spark, sf):
    return rounded(S.survival(log(spark, sf).withColumn("value", F.round("value")), "value", ["event_type"]))


@query("W18_calendar", f"""WITH {NIGHTS}, e AS (SELECT date_trunc('week', min(day))::DATE a, date_trunc('week', max(day))::DATE z FROM nights),
s AS (SELECT unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP + INTERVAL 6 DAY, INTERVAL 1 DAY))::DATE AS day FROM e)
SELECT date_trunc('week', s.day)::DATE AS week, CAST(isodow(s.day) - 1 AS BIGINT) AS dow, {r('v', 'value')} FROM s LEFT JOIN nights n ON n.day = s.day""")  # fmt: skip
def _(spark, sf):
    return rounded(S.calendar(nights(spark, sf), "day", "v"))


@query("W19_adherence", f"WITH {NIGHTS} SELECT count(v) AS nights, {r('avg(v)', 'mean_hours')}, {r('100.0 * count(*) FILTER (v >= 4) / count(v)', 'pct_4h')}, {r('100.0 * count(*) FILTER (v >= 6) / count(v)', 'pct_6h')} FROM nights")
def _(spark, sf):
    return rounded(S.adherence(nights(spark, sf), "v"))


@query("X23_sparkline", f"WITH {NIGHTS} SELECT day, {r('(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())', 'y')} FROM nights WHERE v IS NOT NULL")
def _(spark, sf):
    return rounded(S.sparkline(nights(spark, sf), "day", "v"))


@query("J12_dense_days", """WITH u AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT min(day) a, max(day) z FROM u),
s AS (SELECT unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM e) SELECT s.day, n FROM s LEFT JOIN u ON u.day = s.day""")
def _(spark, sf):
    return S.dense_days(usage(spark, sf), "day", ["n"])


@query("O07_union_days", f"WITH {NIGHTS} SELECT day FROM usage_ UNION SELECT day FROM shipped_")
def _(spark, sf):
    return usage(spark, sf).select("day").union(shipped(spark, sf).select("day")).distinct()


@query("J14_unmatched_days", f"WITH {NIGHTS} SELECT s.day, {r('s.w', 'w')} FROM shipped_ s WHERE NOT EXISTS (SELECT 1 FROM usage_ u WHERE u.day = s.day)")
def _(spark, sf):
    return rounded(shipped(spark, sf).join(usage(spark, sf), "day", "left_anti"))


# --- explorer ------------------------------------------------------------------------------------------------------


@query("F01_date_filter", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'")
def _(spark, sf):
    return E.date_filter(table(spark, sf, "orders"), "o_orderdate", "1996-03-01", "1996-05-31").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("F02_last_days", "WITH e AS (SELECT max(CAST(o_orderdate AS DATE)) z FROM orders) SELECT o_orderkey FROM orders, e WHERE CAST(o_orderdate AS DATE) BETWEEN z - 89 AND z")
def _(spark, sf):
    return E.last_days(table(spark, sf, "orders"), "o_orderdate", 90).select("o_orderkey")


@query("F04_search", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12') OR contains(CAST(c_custkey AS VARCHAR), '12')")
def _(spark, sf):
    return E.search(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "12")


@query("F08_validate_epap", f"WITH {NIGHTS} SELECT day, {r('w', 'w')}, coalesce(w < 4 OR w > 25, false) AS epap_suspicious FROM nights")
def _(spark, sf):
    return rounded(E.validate_epap(nights(spark, sf).select("day", "w"), "w"))


@query("O01_sort_page", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 50 OFFSET 100")
def _(spark, sf):
    return E.sort_rows(table(spark, sf, "part"), "p_size", True).orderBy(F.desc_nulls_last("p_size"), "p_partkey").offset(100).limit(50).select("p_partkey", F.col("p_size"))


# The lines of the aggregates file.
AGGREGATES = {
    "total_nights": ("total_nights", 0), "valid_nights": ("valid_nights", 0), "invalid_nights": ("invalid_nights", 0),
    "avg_usage_hours": ("avg_hours", 3), "median_usage_hours": ("median_hours", 3), "p25_usage_hours": ("p25_hours", 3), "p75_usage_hours": ("p75_hours", 3),
    "min_usage_hours": ("min_hours", 3), "max_usage_hours": ("max_hours", 3), "pct_nights_ge_4h": ("pct_4h", 1),
    "avg_AHI": ("avg_ahi", 3), "median_AHI": ("median_ahi", 3), "p25_AHI": ("p25_ahi", 3), "p75_AHI": ("p75_ahi", 3), "min_AHI": ("min_ahi", 3), "max_AHI": ("max_ahi", 3),
    "median_EPAP": ("median_epap", 3), "p25_EPAP": ("p25_epap", 3), "p75_EPAP": ("p75_epap", 3),
}


@query("S43_aggregates", f"""WITH {NIGHTS}, e AS (SELECT v, w, n / 100.0::DOUBLE AS u FROM nights), a AS (SELECT count(*) AS t, count(u) AS k, avg(u) AS ua, median(u) AS um, quantile_cont(u, 0.25) AS u1, quantile_cont(u, 0.75) AS u3,
 min(u) AS u0, max(u) AS u4, 100.0 * count(*) FILTER (u >= 4) / count(u) AS p, avg(v) AS va, median(v) AS vm, quantile_cont(v, 0.25) AS v1, quantile_cont(v, 0.75) AS v3, min(v) AS v0, max(v) AS v4,
 median(w) AS wm, quantile_cont(w, 0.25) AS w1, quantile_cont(w, 0.75) AS w3 FROM e)
SELECT unnest(['total_nights', 'valid_nights', 'invalid_nights', 'avg_usage_hours', 'median_usage_hours', 'p25_usage_hours', 'p75_usage_hours', 'min_usage_hours', 'max_usage_hours', 'pct_nights_ge_4h',
 'avg_AHI', 'median_AHI', 'p25_AHI', 'p75_AHI', 'min_AHI', 'max_AHI', 'median_EPAP', 'p25_EPAP', 'p75_EPAP']) AS metric,
 unnest([printf('%d', t), printf('%d', k), printf('%d', t - k), printf('%.3f', ua), printf('%.3f', um), printf('%.3f', u1), printf('%.3f', u3), printf('%.3f', u0), printf('%.3f', u4), printf('%.1f', p),
 printf('%.3f', va), printf('%.3f', vm), printf('%.3f', v1), printf('%.3f', v3), printf('%.3f', v0), printf('%.3f', v4), printf('%.3f', wm), printf('%.3f', w1), printf('%.3f', w3)]) AS value FROM a""")  # fmt: skip
def _(spark, sf):
    n = nights(spark, sf).withColumn("u", F.col("n") / F.lit(100.0))
    usage_, ahi, epap = D.usage_summary(n, "u"), D.ahi_trends(n, "day", "v"), D.epap_trends(n, "day", "w", "v")
    share = (100 * X.ratio(F.col("nights_long"), F.col("valid_nights"))).alias("pct_4h")
    one = usage_.select("*", share).join(F.broadcast(ahi)).join(F.broadcast(epap))
    return D.aggregates_csv(one, AGGREGATES)


@query("W08_correlogram", f"""WITH {NIGHTS}, x AS (SELECT row_number() OVER (ORDER BY day) i, v - avg(v) OVER () c FROM nights), k AS (SELECT unnest(range(1, 15)) AS lag)
SELECT CAST(lag AS BIGINT) AS lag, {r('sum(a.c * b.c) / (SELECT sum(c * c) FROM x)', 'acf')}, count(*) AS pairs, {r('1.96 / sqrt((SELECT count(*) FROM x))', 'conf')} FROM k, x a JOIN x b ON b.i = a.i - lag GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return rounded(S.correlogram(nights(spark, sf), "day", "v", 14))


@query("O05_selected_rows", """WITH x AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS k FROM customer) SELECT c_custkey || ',' || c_name AS line FROM x WHERE k IN (0, 7, 40)""")
def _(spark, sf):
    return E.csv_lines(E.select_rows(table(spark, sf, "customer"), [F.desc("c_acctbal"), "c_custkey"], [40, 0, 7]).select("c_custkey", "c_name"))


@query("S45_csv_lines", """SELECT CAST(c_custkey AS VARCHAR) || ',' || c_name || ',"' || replace(c_mktsegment || ', "x"', '"', '""') || '"' AS line FROM customer""")
def _(spark, sf):
    return E.csv_lines(table(spark, sf, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit(', "x"')).alias("segment")))


@query("X01_durations", "SELECT l_orderkey, l_linenumber, CAST(l_quantity * 3600 + l_linenumber * 60 + 5 AS DOUBLE) AS sec FROM lineitem")
def _(spark, sf):
    text = F.concat_ws(":", F.col("l_quantity").cast("int").cast("string"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("05"))
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber"), X.duration_seconds(text).alias("sec"))


@query("X02_normal_quantile", f"SELECT o_orderkey, {r(quantile_sql('((o_orderkey % 997 + 1) / 999.0::DOUBLE)'), 'z')} FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.r6(X.normal_quantile((F.col("o_orderkey") % 997 + 1) / F.lit(999.0))).alias("z"))


@query("X03_normal_cdf", f"""WITH z AS (SELECT o_orderkey, (o_orderkey % 801 - 400) / 100.0::DOUBLE AS z FROM orders), t AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z),
u AS (SELECT *, 0.3989423::DOUBLE * exp(-z * z / 2) * t * (0.3193815::DOUBLE + t * (-0.3565638::DOUBLE + t * (1.781478::DOUBLE + t * (-1.821256::DOUBLE + t * 1.330274::DOUBLE)))) AS u FROM t)
SELECT o_orderkey, {r('CASE WHEN z > 0 THEN 1 - u ELSE u END', 'p')} FROM u""")  # fmt: skip
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.r6(X.normal_cdf((F.col("o_orderkey") % 801 - 400) / F.lit(100.0))).alias("p"))


@query("X05_wilson", f"""WITH g AS (SELECT o_custkey, count(*) n, count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE AS p FROM orders GROUP BY 1),
h AS (SELECT *, 1 + 3.8416 / n AS s, (p + 1.9208 / n) / (1 + 3.8416 / n) AS c, 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n) AS w FROM g)
SELECT o_custkey, {r('greatest(0, c - w)', 'low')}, {r('least(1, c + w)', 'high')} FROM h""")  # fmt: skip
def _(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), (F.count(F.when(F.col("o_orderstatus") == "F", 1)) / F.count(F.lit(1))).alias("p"))
    low, high = X.wilson(F.col("p"), F.col("n"))
    return g.select("o_custkey", X.r6(low).alias("low"), X.r6(high).alias("high"))


@query("X09_labels", f"""WITH {NIGHTS}, x AS (SELECT day, (w - 25) / 25 AS e FROM nights) SELECT day,
 CASE WHEN e IS NULL THEN 'unknown' WHEN abs(e) < 0.1 THEN 'negligible' WHEN abs(e) < 0.3 THEN 'small' WHEN abs(e) < 0.5 THEN 'medium' ELSE 'large' END AS band,
 CASE WHEN e IS NULL THEN NULL WHEN abs(e) >= 0.9 THEN 'very strong' WHEN abs(e) >= 0.7 THEN 'strong' WHEN abs(e) >= 0.5 THEN 'moderate' WHEN abs(e) >= 0.3 THEN 'weak' ELSE 'very weak' END AS strength FROM x""")  # fmt: skip
def _(spark, sf):
    e = (F.col("w") - 25) / 25
    return nights(spark, sf).select("day", X.effect_band(e).alias("band"), X.strength_label(e).alias("strength"))


@query("X10_us_dates", """WITH x AS (SELECT o_orderkey, date_trunc('minute', o_orderdate::TIMESTAMP) AS d FROM orders)
SELECT o_orderkey, CASE WHEN year(d) < 2000 THEN d + INTERVAL 100 YEAR ELSE d END AS ts FROM x""")
def _(spark, sf):
    text = F.date_format("o_orderdate", "M/d/yy H:mm")
    return table(spark, sf, "orders").select("o_orderkey", X.us_timestamp(text).alias("ts"))


@query("X16_json_field", """SELECT event_type, CAST(count(*) AS BIGINT) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return log(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))
