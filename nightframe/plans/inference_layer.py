"""Queries of the inference layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe.functions import exprs as X
from nightframe.operators import inference as I
from nightframe.operators import kernels as K
from nightframe.operators import series as S
from nightframe.plans.frames import NIGHTS, nights, table
from nightframe.plans.nightly import r, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("T01_pearson", f"SELECT o_orderpriority, {r('corr(o_totalprice, o_custkey)', 'r')}, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return rounded(I.pearson(table(spark, sf, "orders"), "o_totalprice", "o_custkey", ["o_orderpriority"]))


def ranked(x: str, y: str, by: str, source: str) -> str:
    over = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"
    return f"SELECT {by}, {over(x)} AS rx, {over(y)} AS ry FROM {source}"


@query("T02_spearman", f"WITH x AS ({ranked('p_size', 'p_retailprice', 'p_brand', 'part')}) SELECT p_brand, {r('corr(rx, ry)', 'r')}, count(*) AS n FROM x GROUP BY 1")
def _(spark, sf):
    return rounded(I.spearman(table(spark, sf, "part"), "p_size", "p_retailprice", ["p_brand"]))


# the tail of Student's t by Simpson's rule over its density, where the library takes a continued fraction
@query("X04_spearman_p", f"""WITH x AS ({ranked('p_size', 'p_retailprice', 'p_brand', 'part')}), c AS (SELECT p_brand, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS rho, count(*) AS n FROM x GROUP BY 1),
t AS (SELECT *, n - 2.0::DOUBLE AS df, abs(rho) * sqrt((n - 2) / nullif(1 - rho * rho, 0)) AS t FROM c), g AS (SELECT unnest(range(0, 4001)) AS i),
s AS (SELECT p_brand, sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2)) * any_value(t) / 12000 AS area FROM t, g WHERE t IS NOT NULL GROUP BY 1)
SELECT t.p_brand, {r('rho', 'r')}, n, {r('CASE WHEN abs(rho) >= 1 THEN 0 ELSE greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * area) END', 'p')} FROM t LEFT JOIN s USING (p_brand)""")  # fmt: skip
def _(spark, sf):
    return rounded(I.spearman_p(table(spark, sf, "part"), "p_size", "p_retailprice", ["p_brand"]))


def partial_sql(x: str, y: str, controls: list[str]) -> str:
    """What the controls leave of a correlation, one control after the other, where the library solves for all at once."""
    if not controls:
        return f"corr({x}, {y})"
    *others, c = controls
    xy, xc, yc = (partial_sql(a, b, others) for a, b in ((x, y), (x, c), (y, c)))
    return f"(({xy}) - ({xc}) * ({yc})) / sqrt((1 - ({xc}) * ({xc})) * (1 - ({yc}) * ({yc})))"


@query("T03_partial_correlation", f"SELECT l_returnflag, l_linestatus, {r(partial_sql('l_extendedprice', 'l_discount', ['l_quantity', 'l_tax']), 'r')}, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return rounded(K.partial_correlations(lines, "l_extendedprice", "l_discount", ["l_quantity", "l_tax"], ["l_returnflag", "l_linestatus"]))


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MATRIX = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})', 'r')}, count(*) AS n FROM lineitem" for a in COLUMNS for b in COLUMNS)


@query("T04_correlation_matrix", MATRIX)
def _(spark, sf):
    return rounded(I.correlation_matrix(table(spark, sf, "lineitem"), COLUMNS))


CONTROLS = ["l_quantity", "l_tax"]
PARTIAL_MATRIX = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})', 'r')}, {r('1.0' if a == b else partial_sql(a, b, [c for c in CONTROLS if c not in (a, b)]), 'partial')} FROM lineitem"
    for a in COLUMNS for b in COLUMNS
)


@query("T04_partial_matrix", PARTIAL_MATRIX)
def _(spark, sf):
    return rounded(K.partial_matrix(table(spark, sf, "lineitem"), COLUMNS, CONTROLS))


@query("O04_strongest", f"WITH m AS ({MATRIX}) SELECT x, y, r FROM m WHERE x < y ORDER BY abs(r) DESC, x, y LIMIT 1")
def _(spark, sf):
    return rounded(I.strongest(I.correlation_matrix(table(spark, sf, "lineitem"), COLUMNS), "r"))


@query("T05_ols", f"SELECT l_returnflag, {r('regr_slope(l_extendedprice, l_quantity)', 'slope')}, {r('regr_intercept(l_extendedprice, l_quantity)', 'intercept')}, {r('corr(l_quantity, l_extendedprice)', 'r')}, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return rounded(I.ols(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


def mann_whitney_sql(source: str, by: str, z: float = 1.96) -> str:
    """``source`` has ``by, v, g``; samples are large enough for the normal form."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""s AS ({source}), k AS (SELECT *, rank() OVER ({part} ORDER BY v) + (count(*) OVER (PARTITION BY {key} v) - 1) / 2.0 AS rk FROM s),
t AS (SELECT {key} sum(c::DOUBLE * (c * c - 1)) AS ties FROM (SELECT {key} v, count(*)::DOUBLE AS c FROM s GROUP BY {key} v) {f'GROUP BY {by}' if by else ''}),
a AS (SELECT {key} count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(rk) FILTER (g)::DOUBLE AS r1 FROM k {f'GROUP BY {by}' if by else ''}),
u AS (SELECT a.*, ties, r1 - n1 * (n1 + 1) / 2.0 AS u1, n1::DOUBLE * n2 - (r1 - n1 * (n1 + 1) / 2.0) AS u2, n1::DOUBLE + n2 AS n FROM a {f'JOIN t USING ({by})' if by else ', t'}),
w AS (SELECT *, (least(u1, u2) - n1::DOUBLE * n2 / 2) / (sqrt(n1::DOUBLE * n2 * (n + 1) / 12) * sqrt(greatest(0, 1 - ties / (n * (n * n - 1))))) AS zz, u2 / (n1::DOUBLE * n2) AS cl, n1::DOUBLE * n2 AS np FROM u),
y AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(zz)) AS tt, 1 + 3.8416 / np AS sc FROM w),
mw AS (SELECT *, 2 * (0.3989423::DOUBLE * exp(-zz * zz / 2) * tt * (0.3193815::DOUBLE + tt * (-0.3565638::DOUBLE + tt * (1.781478::DOUBLE + tt * (-1.821256::DOUBLE + tt * 1.330274::DOUBLE))))) AS pp,
 (cl + 1.9208 / np) / sc AS ce, 1.96 * sqrt(cl * (1 - cl) / np + 0.9604 / (np * np)) / sc AS ha FROM y)"""


MW_OUT = ", ".join(["n1", "n2", r("least(u1, u2)", "u"), r("zz", "z"), r("pp", "p"), r("2 * cl - 1", "effect"), r("2 * greatest(0, ce - ha) - 1", "effect_low"), r("2 * least(1, ce + ha) - 1", "effect_high"), "'normal' AS method"])


@query("T06_mann_whitney", "WITH " + mann_whitney_sql("SELECT o_orderstatus, o_totalprice AS v, o_orderpriority IN ('1-URGENT', '2-HIGH') AS g FROM orders", "o_orderstatus") + f" SELECT o_orderstatus, {MW_OUT} FROM mw")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(I.mann_whitney(o, "o_totalprice", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), ["o_orderstatus"]))


@query("T06_mann_whitney_exact")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(I.mann_whitney(o, "o_totalprice", F.col("o_orderstatus") == "F", [*["o_custkey"]]))


@query("T07_split_test", f"WITH {NIGHTS}, " + mann_whitney_sql("SELECT v, w < 25 AS g FROM nights WHERE v IS NOT NULL AND w IS NOT NULL", "") + f" SELECT {MW_OUT} FROM mw")
def _(spark, sf):
    return rounded(I.mann_whitney(nights(spark, sf), "v", F.col("w") < 25))


RANGES = ("1995-01-01", "1996-12-31"), ("1998-01-01", "1999-12-31")


@query("T08_compare_ranges", f"WITH {NIGHTS}, l AS (SELECT day, 'v' AS measure, v FROM nights UNION ALL SELECT day, 'w', w FROM nights), "
       + mann_whitney_sql("SELECT measure, v, day <= DATE '1996-12-31' AS g FROM l WHERE v IS NOT NULL AND (day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' OR day BETWEEN DATE '1998-01-01' AND DATE '1999-12-31')", "measure")
       + f", m AS (SELECT measure, avg(v) FILTER (g) AS ma, avg(v) FILTER (NOT g) AS mb FROM s GROUP BY 1) SELECT measure, {r('ma', 'mean_a')}, {r('mb', 'mean_b')}, {MW_OUT}, {r('mb - ma', 'delta')} FROM mw JOIN m USING (measure)")
def _(spark, sf):
    return rounded(I.compare_ranges(nights(spark, sf), "day", ["v", "w"], *RANGES))


# neighbours by comparing every row with every grid point, which the library doesn't do
NEAREST = f"""{NIGHTS}, p AS (SELECT w AS x, v AS y, row_number() OVER (ORDER BY w, v) AS i, count(*) OVER () AS n FROM nights WHERE v IS NOT NULL AND w IS NOT NULL),
e AS (SELECT min(x) a, max(x) z FROM p), gr AS (SELECT k AS point, a + (z - a) * k / 19 AS x0 FROM e, (SELECT unnest(range(20)) AS k)),
nb AS (SELECT point, x0, x, y, n, row_number() OVER (PARTITION BY point ORDER BY abs(x - x0), CASE WHEN x < x0 THEN 0 ELSE 1 END, CASE WHEN x < x0 THEN -i ELSE i END) AS place FROM gr, p)"""


@query("T09_loess", f"""WITH {NEAREST}, k AS (SELECT *, max(abs(x - x0)) OVER (PARTITION BY point) AS md FROM nb WHERE place <= greatest(2, floor(0.3::DOUBLE * n))),
w_ AS (SELECT *, pow(greatest(0, 1 - pow(abs(x - x0) / CASE WHEN md > 0 THEN md ELSE 1 END, 3)), 3) AS wt FROM k),
s AS (SELECT point, x0, sum(wt) s, sum(wt * (x - x0)) sx, sum(wt * y) sy, sum(wt * (x - x0) * (x - x0)) sxx, sum(wt * (x - x0) * y) sxy FROM w_ GROUP BY 1, 2)
SELECT CAST(point AS BIGINT) AS point, {r('x0', 'x0')}, {r('(sy - (s * sxy - sx * sy) / (s * sxx - sx * sx) * sx) / s', 'y')} FROM s""")  # fmt: skip
def _(spark, sf):
    n = nights(spark, sf).filter("v is not null and w is not null")
    return rounded(I.loess(n, "w", "v", I.grid_of(n, "w", 20), 0.3))


@query("T10_running_quantile", f"WITH {NEAREST} SELECT CAST(point AS BIGINT) AS point, {r('x0', 'x0')}, {r('quantile_cont(y, 0.9)', 'y')} FROM nb WHERE place <= greatest(3, least(25, n)) GROUP BY point, x0")
def _(spark, sf):
    n = nights(spark, sf).filter("v is not null and w is not null")
    return rounded(I.running_quantile(n, "w", "v", I.grid_of(n, "w", 20), 0.9, 25))


@query("T14_cross_correlation", f"""WITH {NIGHTS}, x AS (SELECT row_number() OVER (ORDER BY day) i, v, w FROM nights), k AS (SELECT unnest(range(-7, 8)) AS lag)
SELECT CAST(lag AS BIGINT) AS lag, {r('corr(a.v, b.w)', 'r')}, count(b.w) AS n, {r('1.96 / sqrt((SELECT count(*) FROM x))', 'conf')} FROM k, x a LEFT JOIN x b ON b.i = a.i + lag GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return rounded(S.cross_correlation(nights(spark, sf), "day", "v", "w"))


P_VALUES = "SELECT c_custkey AS id, c_mktsegment AS family, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE ((c_custkey * 7919) % 10007) / 10007.0::DOUBLE * ((c_custkey * 31) % 17) / 16.0::DOUBLE END AS p FROM customer"


@query("T15_benjamini_hochberg", f"""WITH t AS ({P_VALUES}), k AS (SELECT *, count(p) OVER (PARTITION BY family) m, row_number() OVER (PARTITION BY family ORDER BY p, id) k FROM t WHERE p IS NOT NULL),
q AS (SELECT *, least(1, min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q, max(CASE WHEN p <= k / m * 0.05 THEN k END) OVER (PARTITION BY family) AS cut FROM k)
SELECT id, family, {r('p', 'p')}, {r('q', 'q_value')}, coalesce(k <= cut, false) AS survives FROM q UNION ALL SELECT id, family, NULL, NULL, false FROM t WHERE p IS NULL""")  # fmt: skip
def _(spark, sf):
    c = table(spark, sf, "customer")
    p = F.when(F.col("c_custkey") % 10 != 0, ((F.col("c_custkey") * 7919) % 10007) / F.lit(10007.0) * ((F.col("c_custkey") * 31) % 17) / F.lit(16.0))
    return rounded(I.benjamini_hochberg(c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("family"), p.alias("p")), "p", "id", ["family"]))


@query("T16_heavy_ties", f"""WITH l AS (SELECT l_returnflag, 'q' c, l_quantity v FROM lineitem UNION ALL SELECT l_returnflag, 't', l_tax FROM lineitem), k AS (SELECT l_returnflag, c, v, count(*) n FROM l GROUP BY ALL),
e AS (SELECT l_returnflag, c, max(n) / sum(n) AS t FROM k GROUP BY 1, 2) SELECT l_returnflag, max(t) > 0.2 AS heavy, {r('max(t)', 'top_share')} FROM e GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return rounded(I.heavy_ties(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], ["l_returnflag"]))


@query("T17_permutation")
def _(spark, sf):
    return rounded(I.permutation_tests(table(spark, sf, "part"), "p_size", "p_retailprice", ["p_brand"]))


@query("T18_effective_n", f"""WITH {NIGHTS}, x AS (SELECT day, v, w, lag(v) OVER (ORDER BY day) pv, lag(w) OVER (ORDER BY day) pw, avg(v) OVER () mv, avg(w) OVER () mw FROM nights WHERE w IS NOT NULL),
s AS (SELECT count(*) n, sum((v - mv) * (pv - mv)) / sum((v - mv) * (v - mv)) AS a, sum((w - mw) * (pw - mw)) / sum((w - mw) * (w - mw)) AS b FROM x)
SELECT n, {r('a', 'r1x')}, {r('b', 'r1y')}, {r('greatest(2, least(n, n * (1 - a * b) / (1 + a * b)))', 'n_eff')} FROM s""")  # fmt: skip
def _(spark, sf):
    n = nights(spark, sf).filter("w is not null").withColumn("one", F.lit(1))
    a = S.first_lag(n, "day", "v", ["one"]).withColumnRenamed("r1", "r1x")
    b = S.first_lag(n, "day", "w", ["one"]).withColumnRenamed("r1", "r1y")
    out = n.groupBy("one").agg(F.count(F.lit(1)).alias("n")).join(a, "one").join(b, "one")
    return rounded(out.select("n", "r1x", "r1y", S.effective_n(F.col("n"), F.col("r1x"), F.col("r1y")).alias("n_eff")))


@query("T19_lag_profile", f"""WITH {NIGHTS}, k AS (SELECT unnest(range(-7, 8)) AS lag), m AS (SELECT lag, a.v AS x, b.w AS y FROM k, nights a JOIN nights b ON b.day = a.day + CAST(lag AS INTEGER) WHERE a.v IS NOT NULL AND b.w IS NOT NULL),
q AS ({ranked('x', 'y', 'lag', 'm')}) SELECT CAST(lag AS BIGINT) AS lag, {r('corr(rx, ry)', 'rho')}, count(*) AS n FROM q GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return rounded(S.lag_profile(nights(spark, sf), "day", "v", "w"))
