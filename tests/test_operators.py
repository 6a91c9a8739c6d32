"""Worked examples of the operators."""

import random
import itertools
import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframe import cli
from nightframe import params as P
from nightframe.functions import exprs as X
from nightframe.operators import descriptive as D
from nightframe.operators import engine, explorer, kernels
from nightframe.operators import events as E
from nightframe.operators import inference as I
from nightframe.operators import series as S
from nightframe.operators import wearable as N
from nightframe.plans.inference_layer import QUERIES
from nightframe.plans.ingest import ingest, manifest_of
from nightframe.sources import export_tree, parsers, store, tabular

DAY = dt.date(2021, 1, 1)


def nights(spark, values, step=1):
    return spark.createDataFrame([(DAY + dt.timedelta(days=i * step), v) for i, v in enumerate(values)], "day date, v double")


def one(df):
    return df.collect()[0].asDict(recursive=True)


def scalar(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("1:02:03", 3723), ("2:03", 123), ("45", 45), ("abc", None), ("1:2:3:4", None), ("", None), (None, None), ("1:02.5", 62.5), ("-1:00", None)])
def test_durations(spark, text, want):
    assert scalar(spark, X.duration_seconds(F.lit(text))) == want


def test_dates(spark):
    assert scalar(spark, X.us_timestamp(F.lit("01/02/21 03:04:05"))) == dt.datetime(2021, 1, 2, 3, 4, 5)
    assert scalar(spark, X.us_timestamp(F.lit("1/2/2021"))) == dt.datetime(2021, 1, 2)
    assert scalar(spark, X.us_timestamp(F.lit("13/45/21"))) is None
    assert scalar(spark, X.iso_wall(F.lit("2021-01-02T03:04:05Z"))) == dt.datetime(2021, 1, 2, 3, 4, 5)
    assert scalar(spark, X.iso_instant(F.lit("2021-01-02T03:04:05"))) is None
    assert scalar(spark, X.iso_wall(F.lit("1999-01-02"))) is None
    assert scalar(spark, X.offset_minutes(F.lit("-08:00"))) == -480
    assert scalar(spark, X.offset_minutes(F.lit("+0530"))) == 330


def test_normal_functions(spark):
    assert scalar(spark, X.normal_quantile(F.lit(0.841344746))) == pytest.approx(1, abs=1e-4)
    assert scalar(spark, X.normal_quantile(F.lit(0.158655254))) == pytest.approx(-1, abs=1e-4)
    assert scalar(spark, X.normal_cdf(F.lit(1.96))) == pytest.approx(0.975, abs=1e-4)


def test_not_a_number_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (float("inf"),), (None,)], "v double")
    out = one(D.quantiles(df, "v", {"median": 0.5}))
    assert out == {"n": 2, "median": 2.0}
    assert one(D.quantiles(df.filter("false"), "v", {"median": 0.5})) == {"n": 0, "median": None}


def test_spread_quantiles(spark):
    """Skewed values, many ties, a series without values and one without a name: as the aggregate function gives them."""
    rng = np.random.default_rng(8)
    rows = [("a", float(v)) for v in rng.exponential(1000, 501)] + [("b", float(v)) for v in rng.integers(0, 3, 300)] + [(None, 5.0), (None, 7.0), ("c", None), ("c", float("nan")), ("d", -1e9)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"lo": 0.0, "p5": 0.05, "p25": 0.25, "median": 0.5, "p95": 0.95, "hi": 1.0}
    for frame, by in ((df, ["g"]), (df, []), (df.filter("false"), ["g"]), (df.filter("false"), [])):
        plain, spread = (sorted(map(tuple, D.quantiles(frame, "v", points, by, spread=s).collect()), key=str) for s in (False, True))
        assert len(plain) == len(spread)
        for a, b in zip(plain, spread, strict=True):
            assert [x if not isinstance(x, float) else pytest.approx(x) for x in a] == list(b)


def test_usage_summary(spark):
    df = spark.createDataFrame([("01:30:00",), ("bad",), (None,)], "t string").withColumn("h", X.hours("t"))
    out = one(D.usage_summary(df, "h"))
    assert (out["total_nights"], out["valid_nights"], out["invalid_nights"], out["avg_hours"]) == (3, 1, 2, 1.5)
    two = one(D.usage_summary(nights(spark, [1.0, 3.0]), "v"))
    assert (two["avg_hours"], two["median_hours"], two["iqr_hours"]) == (2, 2, 1)
    assert one(D.usage_summary(nights(spark, []), "v"))["total_nights"] == 0 if D.usage_summary(nights(spark, []), "v").count() else True


def test_trends(spark):
    out = one(D.ahi_trends(nights(spark, [1.0, 5.0, 10.0]), "day", "v"))
    assert out["avg_ahi"] == pytest.approx(16 / 3) and out["median_ahi"] == 5 and out["nights_over5"] == 1
    df = spark.createDataFrame([(DAY, 5.0, 1.0), (DAY + dt.timedelta(1), 9.0, 3.0)], "day date, e double, a double")
    e = one(D.epap_trends(df, "day", "e", "a"))
    assert (e["median_epap"], e["iqr_epap"], e["avg_ahi_low"], e["avg_ahi_high"]) == (7, 2, 1, 3) and e["corr_epap_ahi"] == pytest.approx(1)


def test_rolling_by_calendar_days(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1), 2.0), (dt.date(2021, 1, 2), 4.0), (dt.date(2021, 1, 5), 6.0), (dt.date(2021, 1, 6), None)], "day date, v double")
    out = {r["day"].day: r for r in S.rolling(df, "day", "v", 3).collect()}
    assert [out[d]["avg"] for d in (1, 2, 5, 6)] == [2, 3, 6, 6]
    assert out[1]["avg_low"] is None and out[5]["median"] == 6 and out[2]["avg_low"] < 3 < out[2]["avg_high"]


def test_streaks_ignore_date_gaps(spark):
    out = {r["threshold"]: r["longest"] for r in S.streaks(nights(spark, [5.0, 5.0, 1.0, 7.0, 7.0, 7.0], 3), "day", "v", [4, 6, 9]).collect()}
    assert out == {4.0: 3, 6.0: 3, 9.0: 0}


def test_autocorrelation(spark):
    out = S.autocorrelation(nights(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), "day", "v", 10).orderBy("lag").collect()
    assert [r["acf"] for r in out] == pytest.approx([1, 0.4, -0.1, -0.4, -0.4]) and [r["pairs"] for r in out] == [5, 4, 3, 2, 1]
    gap = {r["lag"]: r for r in S.autocorrelation(nights(spark, [1.0, 2.0, None, 3.0, 4.0]), "day", "v", 2).collect()}
    assert gap[1]["pairs"] == 2 and gap[1]["acf"] > 0
    assert all(r["acf"] is None for r in S.autocorrelation(nights(spark, [2.0, 2.0, 2.0]), "day", "v", 1).collect())


def test_survival(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (3.0,)], "d double")
    out = S.survival(df, "d").orderBy("time").collect()
    assert [r["survival"] for r in out] == pytest.approx([0.5, 0.25, 0])
    assert [r["lower"] for r in out[:2]] == pytest.approx([0.0578428, 0.00894687], abs=1e-5) and out[2]["lower"] is None
    assert [r["upper"] for r in out[:2]] == pytest.approx([0.844865, 0.665331], abs=1e-5)


def at(spark, rows, schema="t double, dur double"):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], schema)


def flow_at(spark, rows):
    return at(spark, rows, "t double, level double")


def test_gap_clusters(spark):
    p = P.ClusterParams("agglomerative", gap=120)
    got = E.clusters(at(spark, [(0, 10), (50, 5)]), flow_at(spark, []), p).collect()
    assert len(got) == 1 and got[0]["end"] == 55
    single = E.clusters(at(spark, [(0, 10), (20, 10), (600, 10)]), flow_at(spark, []), P.ClusterParams("agglomerative", gap=30)).orderBy("start").collect()
    assert [r["count"] for r in single] == [2, 1]


def test_bridging(spark):
    p = P.ClusterParams(gap=30, bridge_gap=90, bridge_threshold=0.15, edge_enter=9)
    events = at(spark, [(0, 10), (70, 10)])
    assert E.clusters(events, flow_at(spark, [(40, 0.2)]), p).count() == 1
    assert E.clusters(events, flow_at(spark, [(40, 0.1)]), p).count() == 2


def test_edges_and_density(spark):
    p = P.ClusterParams(gap=120, edge_enter=0.5, edge_exit=0.35, edge_min=5)
    got = E.clusters(at(spark, [(60, 10)]), flow_at(spark, [(30, 0.6), (40, 0.45), (50, 0.38)]), p).collect()
    assert got[0]["start"] == 30 and got[0]["end"] == 70
    dense = P.ClusterParams(gap=300, min_density=1.5)
    assert E.clusters(at(spark, [(0, 10), (180, 10)]), flow_at(spark, []), dense).count() == 0
    three = E.clusters(at(spark, [(0, 10), (40, 10), (80, 10)]), flow_at(spark, []), P.ClusterParams()).collect()[0]
    assert three["weighted_density"] == pytest.approx(20)
    with pytest.raises(ValueError):
        E.clusters(at(spark, []), flow_at(spark, []), P.ClusterParams("other"))


def test_false_negatives(spark):
    far = at(spark, [(86400, 10)])
    got = E.false_negatives(flow_at(spark, [(0, 1.0), (60, 1.0)]), far, P.FALSE_NEGATIVES["balanced"]).collect()
    assert len(got) == 1 and got[0]["peak"] == 1
    near = at(spark, [(63, 10)])
    assert E.false_negatives(flow_at(spark, [(0, 1.0), (60, 1.0)]), near, P.FALSE_NEGATIVES["balanced"]).count() == 0
    soft = flow_at(spark, [(0, 0.8), (40, 0.8)])
    assert E.false_negatives(soft, far, P.FALSE_NEGATIVES["strict"]).count() == 0
    assert E.false_negatives(soft, far, P.FalseNegativeParams(0.7, 0.7, 30)).count() == 1


def test_rank_test(spark):
    def run(a, b):
        df = spark.createDataFrame([(float(v), True) for v in a] + [(float(v), False) for v in b], "v double, g boolean")
        return one(I.mann_whitney(df, "v", F.col("g")))

    out = run([1, 2], [3, 4])
    assert out["method"] == "exact" and out["p"] == pytest.approx(2 / 6) and out["effect"] == 1
    assert run([3, 4], [1, 2])["effect"] == -1
    assert run([1], [])["method"] == "NA"
    assert run([5] * 20, [5] * 20)["z"] == 0


def test_correlations_guard_constant_sides(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, 7.0, 7.0)], "x double, y double, c double")
    assert one(I.pearson(df, "x", "c"))["r"] is None and one(I.spearman(df, "x", "y"))["r"] == pytest.approx(1)
    assert {(r["x"], r["y"]): r["r"] for r in I.correlation_matrix(df, ["x", "c"]).collect()}[("c", "c")] is None


def test_loess_follows_a_line(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    for r in I.loess(df, "x", "y", I.grid_of(df, "x", 7), 0.4).collect():
        assert r["y"] == pytest.approx(2 * r["x0"] + 1, abs=1e-6)


def test_false_discovery(spark):
    df = spark.createDataFrame([("a", 0.009), ("b", 0.04), ("c", 0.06), ("d", 0.0001), ("e", None)], "id string, p double")
    out = {r["id"]: r for r in I.benjamini_hochberg(df, "p", "id").collect()}
    assert {k for k, r in out.items() if r["survives"]} == {"a", "d"} and out["e"]["q_value"] is None


def test_lag_sign(spark):
    x = [float((i * 37) % 23) for i in range(40)]
    df = spark.createDataFrame([(DAY + dt.timedelta(i), x[i], x[i - 2] if i >= 2 and i % 9 else None) for i in range(40)], "day date, x double, y double")
    best = max(S.lag_profile(df, "day", "x", "y").collect(), key=lambda r: r["rho"] or -1)
    assert best["lag"] == 2 and best["rho"] > 0.9


def test_explorer(spark):
    df = spark.createDataFrame([("a,b", "2021-01-02", 1), ('q"', None, None), ("Zed", "2021-03-01", 3)], "s string, d string, n int")
    assert explorer.search(df, "ZED").count() == 1
    assert explorer.date_filter(df, "d", "2021-02-01", None).count() == 2
    assert explorer.date_filter(df, "d", "2021-02-01", None, keep_undated=False).count() == 1
    for down in (True, False):
        assert explorer.sort_rows(df, "n", down).collect()[-1]["n"] is None
    assert [r[0] for r in explorer.csv_lines(df.select("s")).collect()] == ['"a,b"', '"q"""', "Zed"]
    assert explorer.find_column(df, "^D$") == "d" and explorer.numeric_columns(df) == ["n"]


def test_headers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Date,AHI,Median EPAP,Total Time,x\n2021-01-01,5.2abc,8,7:30:00,k\nbad,,,,\n")
    (tmp_path / "d.csv").write_text("Event,DateTime\nFLG,2021-01-01T00:00:00Z\n")
    out = tabular.read_summary(spark, str(tmp_path / "s.csv")).collect()
    assert (out[0]["usage_hours"], out[0]["ahi"], out[1]["day"]) == (7.5, 5.2, None)
    assert tabular.read_summary(spark, str(tmp_path / "s.csv"), compat_usage=True).first()["usage_hours"] == 7
    with pytest.raises(tabular.MissingColumns, match="Data/Duration"):
        tabular.read_details(spark, str(tmp_path / "d.csv"))
    assert tabular.classify(spark, str(tmp_path / "d.csv")) == "details" and tabular.classify(spark, str(tmp_path / "s.csv")) == "summary"


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    """Columns change places and names from file to file, some are missing, one file is compressed, one is empty."""
    import gzip

    folder = tmp_path / "rates"
    folder.mkdir()
    (folder / "a.csv").write_text("timestamp,deep_sleep_breathing_rate,light_sleep_breathing_rate\n2021-01-01T00:00:00,10,20\n")
    (folder / "b.csv").write_text("light_sleep_breathing_rate,timestamp,deep_sleep_breathing_rate\n20,2021-01-02T00:00:00,10\n")
    (folder / "c.csv").write_text("timestamp,light_breathing_rate,deep_breathing_rate,signal_to_noise\n2021-01-03T00:00:00,20,10,3\n")
    (folder / "d.csv.gz").write_bytes(gzip.compress(b"deep_breathing_rate,timestamp\n10,2021-01-04T00:00:00\n"))
    (folder / "e.csv").write_text("")
    for where in ([str(p) for p in sorted(folder.iterdir())], str(folder), str(folder / "*")):
        out = parsers.resp_rate_stage(spark, where).orderBy("night").collect()
        assert [(r["night"].day, r["rr_deep"], r["rr_light"]) for r in out] == [(1, 10, 20), (2, 10, 20), (3, 10, 20), (4, 10, None)] and out[2]["rr_signal_to_noise"] == 3
        assert [r["file"].rsplit("/", 1)[1] for r in out] == ["a.csv", "b.csv", "c.csv", "d.csv.gz"]
    assert dict(tabular.read_csv(spark, str(folder / "a.csv"), typed=True).dtypes)["deep_sleep_breathing_rate"] == "int"
    assert tabular.read_csv(spark, [str(folder / "e.csv")]).count() == 0


def test_normalized_intervals(spark):
    df = spark.createDataFrame(
        [(1, "2021-01-02T03:00:00Z", None, [("2021-01-01T00:00:00Z", 1)]), (2, None, "bad", [("x", 1), ("2021-01-05T00:00:00Z", 2), ("2021-01-06T00:00:00Z", 3), None]), (3, "bad", "2021-01-02T00:00:00Z", [])],
        "id int, start string, end string, events array<struct<date:string,k:int>>",
    )
    plain = {r["id"]: r for r in E.normalize_intervals(df.drop("events")).collect()}
    assert set(plain) == {1} and plain[1]["end"] == plain[1]["start"] == dt.datetime(2021, 1, 2, 3)
    full = {r["id"]: r for r in E.normalize_intervals(df, events="events").collect()}
    assert set(full) == {1, 2} and [e["k"] for e in full[2]["events"]] == [2, 3]
    assert (full[2]["start"], full[2]["end"]) == (dt.datetime(2021, 1, 5), dt.datetime(2021, 1, 6)) and full[1]["end"] == dt.datetime(2021, 1, 1)


def test_selected_rows_options_and_ranges(spark):
    df = spark.range(20).withColumn("v", (F.col("id") * 7) % 20)
    assert [r["v"] for r in explorer.select_rows(df, ["v"], [5, 0, 5]).collect()] == [0, 5] and explorer.select_rows(df, ["v"], []).count() == 20
    assert P.ClusterParams.from_options({"min_density_per_min": 2.0, "gap": 5.0, "other": 1}) == P.ClusterParams(gap=5.0, min_density=2.0)
    assert P.ClusterParams.from_options({"min_density": 0, "min_density_per_min": 2.0}).min_density == 0
    row = spark.createDataFrame([(dt.datetime(2021, 1, 2), None)], "a timestamp, b timestamp").select(X.range_texts("a", "b").alias("r")).first()["r"]
    assert (row["start"], row["end"]) == ("2021-01-02T00:00:00.000Z", None)
    assert scalar(spark, X.maybe_date(F.lit("2021-01-02T00:00:00Z"))) == dt.datetime(2021, 1, 2) and scalar(spark, X.maybe_date(F.lit("no"))) is None
    assert S.dense_days(nights(spark, [1.0, 2.0], 6000), "day", ["v"]).count() == 6001
    assert [r["lag"] for r in S.correlogram(nights(spark, [1.0, 2.0, 4.0]), "day", "v", 9).orderBy("lag").collect()] == [1, 2]


def test_partials_from_moments(spark):
    rng = np.random.default_rng(3)
    rows = [("a" if k % 3 else "b", *map(float, rng.normal(size=2) + [k % 5, k % 7]), float(k % 5), None if k % 11 == 0 else float(k % 7)) for k in range(300)] + [("c", 1.0, 2.0, 3.0, 4.0)] * 5
    df = spark.createDataFrame(rows, "g string, x double, y double, p double, q double")
    got = {r["g"]: r for r in kernels.partial_correlations(df, "x", "y", ["p", "q"], ["g"]).collect()}
    for g in "ab":
        own = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows if r[0] == g])
        assert got[g]["r"] == pytest.approx(kernels.partial_correlation(own[:, 0], own[:, 1], own[:, 2:])) and got[g]["n"] == len(own)
    assert got["c"]["r"] is None
    # a control twice makes the system singular: the raw series count
    twice = kernels.partial_correlations(df, "x", "y", ["p", "p"], ["g"]).filter("g = 'a'").first()["r"]
    own = np.array([r[1:4] for r in rows if r[0] == "a"])
    assert twice == pytest.approx(np.corrcoef(own[:, 0], own[:, 1])[0, 1])
    matrix = {(r["x"], r["y"]): r for r in kernels.partial_matrix(df, ["x", "y", "p"], ["p", "q"]).collect()}
    full = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    assert matrix[("x", "y")]["partial"] == pytest.approx(kernels.partial_correlation(full[:, 0], full[:, 1], full[:, 2:])) and matrix[("x", "x")]["partial"] == 1
    assert matrix[("x", "p")]["partial"] == pytest.approx(kernels.partial_correlation(full[:, 0], full[:, 2], full[:, 3:]))


def brute_cuts(t, k):
    """The least sum of squares of all partitions of sorted points into ``k`` runs at most."""
    square = lambda x: float(((np.array(x) - np.mean(x)) ** 2).sum())
    return min(sum(square(t[a:b]) for a, b in itertools.pairwise((0, *cut, len(t)))) for cut in itertools.combinations(range(1, len(t)), min(k, len(set(t))) - 1))


@pytest.mark.parametrize("bins", [1024, 12])
def test_kmeans(spark, monkeypatch, bins):
    """The best of all partitions; with fewer bins than starts nearly so, with means that no round moves any more."""
    monkeypatch.setattr(E, "BINS", bins)
    rnd = random.Random(bins)
    rows = [(who, 1.7e9 + round(rnd.choice([0, 500, 520, 3000]) + rnd.gauss(0, 60), 3), 5.0) for who in ("a", "b", None) for _ in range(14 if bins > 100 else 60)]
    rows += [("c", 7.0, 1.0)] * 3 + [("d", None, 1.0), ("e", 1.0, 0.0), ("e", 2.0, 0.0)]
    df = spark.createDataFrame(rows, "who string, t double, dur double")
    got = E.kmeans_clusters(df, P.ClusterParams("kmeans", k=3), ["who"]).collect()
    assert len(got) == len(rows) - 1
    for who in ("a", "b", "c", "e", None):
        mine = sorted((r for r in got if r["who"] == who), key=lambda r: r["t"])
        t, runs = [r["t"] - mine[0]["t"] for r in mine], {}
        for r in mine:
            runs.setdefault(r["cluster"], []).append(r["t"])
        assert [r["cluster"] for r in mine] == sorted(r["cluster"] for r in mine) and set(runs) == set(range(1, min(3, len(set(t))) + 1))
        wcss = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in runs.values())
        assert mine[0]["wcss"] == pytest.approx(wcss, abs=1e-3) and mine[0]["settled"]
        if bins > 100 or len(set(t)) <= bins:
            assert mine[0]["rounds"] == 0 and wcss == pytest.approx(brute_cuts(t, 3), abs=1e-3)
        else:
            assert mine[0]["rounds"] > 0 and wcss <= 1.05 * brute_cuts(t, 3)
    one = E.kmeans_clusters(df.filter("who = 'a'").select("t", "dur"), P.ClusterParams("kmeans", k=2)).collect()
    assert {r["cluster"] for r in one} == {1, 2}
    assert E.kmeans_clusters(df.filter("false"), P.ClusterParams("kmeans"), ["who"]).count() == 0


def test_paths():
    C = export_tree.classify
    assert C("Global Export Data/sleep-2021-01-01.json") == "allowed"
    assert C("Global Export Data/sleep-2021-1-1.json") == "ignored"
    assert C("Account/x.json") == "denied" and C("Menstrual Health/a.csv") == "denied"
    assert C("../Sleep Score/sleep_score.csv") == "denied" and C("Sleep Score/sleep_score.csv") == "allowed"
    assert C("Sleep Score/gps_location_1.csv") == "denied" and C("any/daily_heart_rate_zones.csv") == "denied"
    assert export_tree.describe("Heart Rate Variability/Heart Rate Variability Details - x.csv").metric == "hrv_details"


def test_batch_report(spark, tmp_path):
    lines = ["DateTime,Type,Event,Data/Duration"]
    for t, e, v in (("00:00", "Obstructive", 20), ("01:00", "Obstructive", 20), ("02:00", "Mixed", 30), ("01:30", "FLG", 0.2)):
        lines.append(f"2021-01-01T00:{t}Z,x,{e},{v}")
    (tmp_path / "d.csv").write_text("\n".join(lines))
    got = cli.report(spark, str(tmp_path / "d.csv"), "2021-01-01", P.ClusterParams()).collect()
    assert len(got) == 1 and got[0]["count"] == 3 and got[0]["min_flg"] == got[0]["max_flg"] == pytest.approx(0.2)


def write_export(root):
    def put(path, text):
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text if isinstance(text, str) else json.dumps(text))

    def session(i, log, deep=70):
        d = dt.date(2021, 3, 1) + dt.timedelta(i)
        return {"logId": log, "dateOfSleep": str(d), "startTime": f"{d - dt.timedelta(1)}T23:00:00.000", "endTime": f"{d}T07:00:00.000", "type": "stages", "mainSleep": True, "timeInBed": 480, "minutesAsleep": 420, "minutesAwake": 60, "minutesToFallAsleep": 10, "minutesAfterWakeup": 5, "efficiency": 90, "levels": {"summary": {"deep": {"minutes": deep}, "light": {"minutes": 250}, "rem": {"minutes": 100}, "wake": {"minutes": 60}}}}

    put("Global Export Data/sleep-2021-03-01.json", [session(i, 100 + i) for i in (0, 1, 2, 4)])
    put("Global Export Data/sleep-2021-03-02.json", [session(0, 100), {"logId": None}])
    put("Global Export Data/sleep-2021-03-03.json", "{not valid json")
    put("Sleep Score/sleep_score.csv", "sleep_log_entry_id,overall_score\n100,81\n,3\n")
    put("Account/secret.csv", "x\n1\n")
    spo2 = ["timestamp,value"]
    for i in range(3):
        d = dt.datetime(2021, 3, 1 + i, 7, 0)
        spo2 += [f"{(d + dt.timedelta(minutes=2 * k)).isoformat()}Z,{50.0 if k < 2 else 68 if k == 2 else 95}" for k in range(240)]
    put("Oxygen Saturation (SpO2)/Minute SpO2 - a.csv", "\n".join(spo2))
    put("Health Fitness Data_GoogleData/UserSleeps_1.csv", "sleep_start,start_utc_offset\n2021-03-01T06:00:00Z,+00:00\n")
    put("Global Export Data/heart_rate-2021-03-01.json", [{"dateTime": f"03/01/21 {h:02d}:{m:02d}:00", "value": {"bpm": 60 + m % 5, "confidence": 2}} for h in range(7) for m in range(60)])
    put("Heart Rate Variability/Heart Rate Variability Details - a.csv", "timestamp,rmssd,coverage\n2021-03-01T01:00:00,30,0.9\n2021-03-01T01:05:00,34,0.7\n2021-03-02T01:00:00,30,0.2\n")
    put("Global Export Data/steps-2021-03-01.json", [{"dateTime": "03/01/21 10:00:00", "value": "100"}, {"dateTime": "03/01/21 11:00:00", "value": "50"}, {"dateTime": "x", "value": "1"}])
    put("Stress Score/Stress Score.csv", "DATE,STRESS_SCORE,CALCULATION_FAILED\n2021-03-01,70,false\n2021-03-02,0,TRUE\n")


def test_ingest(spark, tmp_path):
    write_export(tmp_path)
    got = ingest(spark, str(tmp_path))
    rows = {r["night"].day: r for r in got.nights.collect()}
    assert sorted(rows) == [1, 2, 3, 5]
    first = rows[1]
    assert first["deep_min"] == 70 and len(first["source_files"]) == 2 and first["score"] == 81 and first["waso_min"] == 45
    assert first["utc_offset_min"] == -480 and first["window_source"] == "inferred"
    assert first["spo2"]["min_pct"] == 68 and first["sentinel_minutes_removed"] == 2 and "spo2-sub-70" in first["flags"]
    assert first["hr"]["sample_count"] == 420 and first["hrv"]["rmssd_ms"] == pytest.approx(32) and first["steps"] == 150
    assert rows[2]["hrv"] is None and rows[2]["insufficient"] == ["hrv"] and rows[2]["stress_score"] is None and rows[3]["hrv"] is None and rows[3]["insufficient"] == []
    assert rows[5]["spo2"] is None and rows[5]["window_source"] == "carry-forward"
    bad = {r["metric"]: r["m"] for r in got.malformed.groupBy("metric").agg(F.sum("malformed").alias("m")).collect()}
    assert bad["sleep"] == 2 and bad["sleep_score"] == 1 and bad["steps"] == 1
    series = {(r["night"].day, r["metric"]): r for r in got.intraday.collect()}
    assert len(series[(1, "hr")]["values"]) == 420 and series[(1, "spo2")]["values"][0] == 68
    again = ingest(spark, str(tmp_path), manifest=manifest_of(spark, got.files), since="2021-03-02")
    assert {r["night"].day for r in again.nights.collect()} == {3, 5} and not any(f.kind.phase == "series" for f in again.files)


def test_store(spark, tmp_path):
    path = str(tmp_path / "nights")
    df = lambda rows: spark.createDataFrame([(dt.date.fromisoformat(d), v) for d, v in rows], "night date, v int")
    store.upsert(spark, path, df([("2021-01-01", 1), ("2021-01-02", 2), ("2021-02-01", 3)]), ["night"])
    store.upsert(spark, path, df([("2021-01-02", 9), ("2021-01-03", 4)]), ["night"])
    got = {str(r["night"]): r["v"] for r in store.nights_between(spark, path, "2021-01-01", "2021-12-31").collect()}
    assert got == {"2021-01-01": 1, "2021-01-02": 9, "2021-01-03": 4, "2021-02-01": 3}
    secret = store.encrypt_rows(df([("2021-01-01", 1)]), "Passphrase-123!")
    assert store.decrypt_rows(secret, "Passphrase-123!", "night date, v int").collect()[0]["v"] == 1
    with pytest.raises(Exception, match="AES|CRYPTO"):
        store.decrypt_rows(secret, "wrong", "night date, v int").collect()
    assert [store.passphrase_strength(p)[:2] for p in ("", "short7!", "longenough", "Longenough12", "Passphrase-123!")] == [(False, "weak"), (False, "weak"), (True, "weak"), (True, "moderate"), (True, "strong")]
    assert store.passphrase_strength("alllowercase")[2] == ["upper-case letters", "digits", "symbols"]
    repeated = spark.createDataFrame([(dt.date(2021, 1, 2), v) for v in (5, 8, 3)], "night date, v int")
    store.upsert(spark, path, repeated, ["night"])
    assert {r["v"] for r in store.nights_between(spark, path, "2021-01-02", "2021-01-02").collect()} == {8}
    assert [p.name for p in tmp_path.iterdir() if "staged" in p.name] == []
    assert store.get_meta(spark, path, "folder") is None
    for value in ("a", "b'\"ü"):
        store.set_meta(spark, path, "folder", value)
        assert store.get_meta(spark, path, "folder") == value
    store.clear_all(spark, path)
    assert store.get_meta(spark, path, "folder") is None and not (tmp_path / "nights").exists()
    bad = spark.createDataFrame([("hr", 2, 9), ("hr", 1, 4), ("spo2", 3, 3)], "metric string, malformed bigint, rows bigint")
    got = spark.createDataFrame([("hr", dt.date(2021, 1, 2)), ("hr", dt.date(2021, 1, 5))], "metric string, night date")
    totals = {r["metric"]: r for r in store.ingest_totals(got, bad).collect()}
    assert (totals["hr"]["first_night"].day, totals["hr"]["last_night"].day, totals["hr"]["rows_kept"], totals["hr"]["malformed"]) == (2, 5, 2, 3) and totals["spo2"]["rows_kept"] == 0
    store.save_session(spark, str(tmp_path / "s"), df([("2021-01-01", 1)]), df([]), {"a": "b"})
    assert store.load_session(spark, str(tmp_path / "s"))[2] == {"a": "b"}


def test_alignment(spark):
    d = lambda k: DAY + dt.timedelta(k)
    summary = spark.createDataFrame([(1, d(0), 7.0), (2, d(3), 7.0), (3, d(8), 1.0)], "row_id int, day date, usage_hours double")
    worn = spark.createDataFrame([(d(0), 420.0, None), (d(4), 400.0, None), (d(9), 400.0, None)], "night date, asleep_min double, window_min double")
    out = {r["row_id"]: r for r in N.align(summary, worn).collect()}
    assert out[1]["match_type"] == "exact" and out[2]["match_type"] == "shifted+1" and 3 not in out


def test_ties_go_to_the_last_believed_offset(spark):
    """The first night fits only -300; the second fits many offsets equally, the third has too few samples, the fourth as the second."""
    rows = []
    for night, (first, minutes) in {1: (300, 480), 2: (420, 240), 3: (420, 10), 4: (420, 240), 5: (-60, 240)}.items():
        start = night * 10_000.0
        rows += [(night, start, start + 480, start + first + k) for k in range(minutes)]
    near = spark.createDataFrame(rows, "night int, start_min double, end_min double, utc_min double")
    out = {r["night"]: r for r in N.infer_offsets(near).collect()}
    assert [out[n]["offset"] for n in (1, 2, 3, 4)] == [-300, -300, None, -300] and [out[n]["confident"] for n in (1, 2, 3, 4)] == [True, True, False, True]
    assert out[5]["offset"] == 60 and {r["night"]: r["offset"] for r in N.infer_offsets(near.filter("night = 2")).collect()} == {2: -180}


def test_offset_chain(spark):
    rows = [(0, -300, True, None), (1, None, False, None), (2, None, False, 60), (3, None, False, 0), (9, 400, False, None)]
    df = spark.createDataFrame([(DAY + dt.timedelta(i), o, c, h) for i, o, c, h in rows], "night date, offset int, confident boolean, hint int")
    out = [(r["utc_offset_min"], r["window_source"]) for r in N.resolve_offsets(df).orderBy("night").collect()]
    assert out == [(-300, "inferred"), (-300, "carry-forward"), (60, "userSleeps-hint"), (-480, "default-fallback"), (-480, "default-fallback")]


def test_engine_gate(spark):
    def run(n):
        rows = [(DAY + dt.timedelta(i), float(i), 100.0 - i + 0.1 * (i % 3)) for i in range(n)]
        df = spark.createDataFrame(rows, "night date, ahi double, efficiency_pct double")
        return {r["pair_id"]: r for r in engine.run_engine(df, rounds=50)["pairs"].collect()}

    assert run(9)[7]["p_method"] == "none" and run(9)[7]["effect"] == "insufficient-n"
    ok = run(12)[7]
    assert ok["p_method"] == "t" and ok["rho"] < -0.9 and ok["n"] == 12


def test_engine_lag_profile(spark):
    rows = [(DAY + dt.timedelta(i), float(i * 7 % 12), float((i - 2) * 7 % 12)) for i in range(30)]
    df = spark.createDataFrame(rows, "night date, ahi double, efficiency_pct double")
    profile = {r["lag"]: r for r in engine.run_engine(df, rounds=50)["pairs"].filter("pair_id = 7").first()["lag_profile"]}
    assert sorted(profile) == list(range(-P.LAGS, P.LAGS + 1))
    assert profile[2]["rho"] == pytest.approx(1) and profile[2]["n"] == 28 and profile[0]["rho"] < 0.9
    ten = df.filter("night < date_add(DATE'%s', 10)" % DAY)
    assert [r["n"] for r in engine.run_engine(ten, rounds=50)["pairs"].filter("pair_id = 7").first()["lag_profile"]] == [10 - abs(k) for k in range(-P.LAGS, P.LAGS + 1)]


def test_queries_run_over_everything(spark, tmp_path):
    """All orders, and as many permutations as the parameters say."""
    day = dt.date(2024, 1, 1)
    orders = [(k, 1 + k // 5000, float(k % 90), "FO"[k % 2], day) for k in range(1990, 2010)] + [(k, 7, float(k % 90), "FO"[k % 3 % 2], day) for k in range(9000, 9040)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([("a", k, float(k)) for k in range(60)], "p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    out = {r["o_custkey"]: r for r in QUERIES["T06_mann_whitney_exact"](spark, str(tmp_path)).collect()}
    assert {k: r["n1"] + r["n2"] for k, r in out.items()} == {1: 20, 7: 40}
    assert out[1]["method"] == "exact" and out[7]["method"] == "normal"
    assert QUERIES["T17_permutation"](spark, str(tmp_path)).first()["p"] == pytest.approx(1 / (P.PERMUTATIONS + 1), abs=1e-6)
