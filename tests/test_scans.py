"""Work on long series in slices and blocks gives what one window over the whole series gives."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nightframe import params as P
from nightframe.operators import descriptive as D
from nightframe.operators import events as E
from nightframe.operators import inference as I
from nightframe.operators import scans, series
from nightframe.operators import wearable as N


@pytest.fixture
def narrow(monkeypatch):
    """Slices and blocks of a few rows, so that every border is met."""
    monkeypatch.setattr(scans, "ROWS", 3)
    monkeypatch.setattr(series, "BLOCK", 9)


def rows(df):
    cell = lambda v: round(v, 7) if isinstance(v, float) else v
    return sorted((tuple(cell(v) for v in r) for r in df.collect()), key=str)


def same(a, b):
    assert a.columns == b.columns
    assert rows(a) == rows(b)


@pytest.fixture(scope="module")
def days(spark):
    rnd = random.Random(3)
    made = []
    for who in ("a", "b", None):
        day = 0
        for _ in range(150):
            day += rnd.choice([1, 1, 1, 2, 5, 40])
            made.append((who, day, rnd.choice([None, float("nan"), rnd.gauss(5, 2), rnd.gauss(5, 2), rnd.gauss(5, 2)]), rnd.gauss(0, 1)))
    df = spark.createDataFrame(made, "who string, d int, v double, w double")
    return df.select("who", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("day"), "v", "w").cache()


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(5)
    events, flow = [], []
    for who in ("a", "b", None):
        t = 0.0
        for _ in range(160):
            t += rnd.choice([5, 20, 20, 60, 90, 400])
            events.append((who, t, float(rnd.choice([0, 10, 30, 200]))))
            flow += [(who, t + rnd.choice([0.0, 1.0, 15.0]), round(rnd.random(), 2)) for _ in range(3)]
    events += events[:5]  # repeated rows
    return spark.createDataFrame(events, "who string, t double, dur double").cache(), spark.createDataFrame(flow, "who string, t double, level double").cache()


@pytest.mark.parametrize("by", [[], ["who"]])
def test_series(narrow, days, by):
    x = days if by else days.filter("who = 'a'")
    for job in (
        lambda s: series.rolling(x, "day", "v", 7, by, s),
        lambda s: series.rolling(x, "day", "v", 30, by, s),
        lambda s: series.breakpoints(x, "day", "v", "w", 0.5, by, s),
        lambda s: series.decompose(x, "day", "v", 7, by, s),
        lambda s: series.autocorrelation(x, "day", "v", 12, by, s),
    ):
        same(job(True), job(False))


@pytest.mark.parametrize("by", [[], ["who"]])
def test_logs(narrow, log, by):
    events, flow = (x if by else x.filter("who = 'a'") for x in log)
    p = P.ClusterParams(gap=30.0, bridge_gap=90.0, bridge_threshold=0.7, edge_enter=0.8, edge_exit=0.5, edge_min=5.0)
    fn = P.FalseNegativeParams(threshold=0.6, peak=0.8, min_span=1.0, max_span=600.0, gap=60.0)
    for job in (
        lambda s: E.gap_clusters(events, 30.0, by, s).select(*by, "t", "dur", "cluster"),
        lambda s: E.bridged_clusters(events, flow, p, by, s),
        lambda s: E.flow_segments(flow, p, by, s),
        lambda s: E.clusters(events, flow, p, by, s),
        lambda s: E.false_negatives(flow, events.filter("dur > 100"), fn, by, s),
    ):
        same(job(True), job(False))


def test_empty_and_constant(narrow, days, log):
    none = days.filter("false")
    assert series.rolling(none, "day", "v", 7).count() == 0
    assert series.decompose(none, "day", "v").count() == 0
    assert E.gap_clusters(log[0].filter("false"), 30.0).count() == 0
    still = days.filter("who = 'a'").withColumn("day", F.lit("2020-01-01").cast("date"))
    assert {r["n"] for r in series.rolling(still, "day", "w", 7).collect()} == {150}
    assert series.autocorrelation(still, "day", "w", 3).count() == 4


def test_running_sums_and_maxima(narrow, spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(rnd.choice("xyz"), i, rnd.randint(0, 9)) for i in rnd.sample(range(500), 400)], "g string, k int, v int")
    w = W.partitionBy("g").orderBy("k")
    plain = df.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w), "p": F.lag("v").over(w), "i": (F.row_number().over(w) - 1).cast("bigint")})
    x = scans.sliced(df, "k")
    assert x.select("_s").distinct().count() > 50
    x = scans.preceding(scans.running(x, ["k"], {"s": F.col("v")}, {"m": F.col("v")}, ["g"]), ["k"], {"p": F.col("v")}, ["g"]).drop("_s")
    same(scans.numbered(x, "k", ["g"]).withColumnRenamed("_i", "i").select(plain.columns), plain)


def hot(df, by):
    """Windows of the plan that run over whole groups (their partition keys are ``by`` or none)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Window \[.*?\], \[(.*?)\]", plan)
    return [k for k in keys if {re.sub(r"#\d+L?", "", c.split(" ")[0]) for c in k.split(", ")} <= {*by, ""}]


def test_no_window_over_a_whole_series(days, log):
    events, flow = log
    jobs = [
        series.rolling(days, "day", "v", 7), series.breakpoints(days, "day", "v", "w"), series.decompose(days, "day", "v"), series.autocorrelation(days, "day", "v"),
        E.clusters(events, flow, P.ClusterParams()), E.false_negatives(flow, events, P.FALSE_NEGATIVES["balanced"]),
        I.mann_whitney(days, "v", F.col("w") > 0), I.benjamini_hochberg(days.withColumn("p", F.abs("w")), "p", "day"), I.loess(days, "v", "w", I.grid_of(days, "v", 5)),
        series.ranks(days, "v"),
    ]
    for job in jobs:
        assert hot(job, []) == []
    assert hot(series.ranks(days, "v", ["who"]), ["who"]) == []
    assert hot(series.ranks(days, "v", ["who"], spread=False), ["who"]) != []


def test_quantiles_of_skewed_values(spark):
    rnd = random.Random(1)
    values = [rnd.lognormvariate(0, 3) for _ in range(20_000)] + [1e12] + [0.5] * 5_000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    q = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0, "f": 0.0}
    same(D.quantiles(df, "v", q, spread=True), D.quantiles(df, "v", q))
    # slices hold about equal shares, however the values lie
    each = scans.sliced(df.filter("v <> 0.5"), "v", 1).groupBy("_s").count().agg(F.max("count")).first()[0]
    assert each < 0.02 * 20_000


def test_order_statistics_keep_few_rows(spark):
    df = spark.range(100_000).select(F.lit(1).alias("_g"), F.sqrt("id").alias("_x"))
    found = scans.order_statistics(df, {"m": lambda n: (F.floor(n * 0.3), F.floor(n * 0.3) + 1)}).first()
    assert (found["n"], found["_m"]["m"]["lo"], found["_m"]["m"]["hi"]) == (100_000, 30_000**0.5, 30_001**0.5)


def test_false_discovery_of_ties(narrow, spark):
    rnd = random.Random(4)
    p = [rnd.choice([0.001, 0.01, 0.02, 0.2, rnd.random(), None]) for _ in range(200)]
    got = I.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "id int, p double"), "p", "id").collect()
    known = sorted(v for v in p if v is not None)
    m = len(known)
    ratio = {v: v * m / (max(i for i, u in enumerate(known) if u == v) + 1) for v in known}
    cut = max((v for v in known if v <= (known.index(v) + known.count(v)) / m * 0.05), default=-1)
    for r in got:
        if r["p"] is None:
            assert r["q_value"] is None and r["survives"] is False
        else:
            assert r["q_value"] == pytest.approx(min(1, *(ratio[v] for v in known if v >= r["p"])))
            assert r["survives"] == (r["p"] <= cut)


def test_permutations_by_group(spark):
    """Groups of any size by margins; groups without pairs have no p, and rounds are dealt over tasks."""
    rnd = random.Random(8)
    rows = [(g, float(rnd.randrange(5)) if k % 9 else None, float(rnd.randrange(4))) for g in ("a", "b", None) for k in range(50)]
    rows += [("same", float(k), float(k)) for k in range(20)] + [("two", 1.0, 2.0), ("two", 2.0, 1.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in I.permutation_tests(df, "x", "y", ["g"], 350, chunk=100).collect()}
    assert {g: r["n"] for g, r in got.items()} == {"a": 44, "b": 44, None: 44, "same": 20, "two": 2, "none": 0}
    assert got["same"]["p"] == pytest.approx(1 / 351) and got["two"]["p"] is None and got["none"]["p"] is None and all(0 < got[g]["p"] <= 1 for g in ("a", "b", None))
    small = {r["g"]: r for r in I.permutation_tests(df, "x", "y", ["g"], 350, spread=False).collect()}
    assert {g: (r["n"], r["p"] is None) for g, r in small.items()} == {g: (r["n"], r["p"] is None) for g, r in got.items()}
    assert all(abs(small[g]["p"] - got[g]["p"]) < 0.15 for g in ("a", "b", None)) and small["same"]["p"] == got["same"]["p"]
    one = I.permutation_tests(df, "x", "y", rounds=150).collect()
    assert len(one) == 1 and one[0]["n"] == sum(r["n"] for r in got.values())


def test_two_wearers(spark):
    """Interleaved nights and samples of two wearers give the same rows as each alone."""
    rnd = random.Random(12)
    nights, samples = [], []
    for who, shift in (("a", 60), ("b", -300)):
        for night in range(6):
            begin = night * 1440 + 1320
            nights.append((who, night, float(begin), float(begin + 480)))
            samples += [(who, float(begin + k - (shift if night != 3 else 0)), float(k)) for k in range(0, 480, 4 if night != 4 else 200)]
    rnd.shuffle(samples)
    n = spark.createDataFrame(nights, "who string, night int, start_min double, end_min double")
    x = spark.createDataFrame(samples, "who string, utc_min double, v double")
    both = N.infer_offsets(N.samples_near(n, x, by=["who"]), by=["who"])
    local = N.assign_local(n, x.withColumnRenamed("utc_min", "local_min"), ["v"], ["who"])
    for who in "ab":
        mine = [d.filter(F.col("who") == who).drop("who") for d in (n, x)]
        same(both.filter(F.col("who") == who).drop("who"), N.infer_offsets(N.samples_near(*mine)))
        same(local.filter(F.col("who") == who).drop("who"), N.assign_local(mine[0], mine[1].withColumnRenamed("utc_min", "local_min"), ["v"]))
    assert {(r["who"], r["offset"]) for r in both.collect() if r["night"] == 1} == {("a", 60), ("b", -300)}
