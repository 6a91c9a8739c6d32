"""Means that don't depend on the order of the rows."""

import math
from fractions import Fraction

from pyspark.sql import functions as F

from nightframe.functions.exprs import exact_mean
from nightframe.plans import frames


def test_means_are_those_of_fractions(spark):
    groups = {
        1: [0.1] * 7, 2: [-0.5, -0.5], 3: [1e17, 0.3, -1e17], 4: [2.5, None, float("nan")], 5: [None], 6: [1e300, 1e300], 7: [-41.7, -41.3, 1e-9],
        8: [float("inf"), 3.5], 9: [12345.67, 0.01, 99999.99] * 50, 10: [-2.0**40 - 0.25, 0.75], 11: [5e-324],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double").repartition(4)
    for row in df.groupBy("k").agg(exact_mean("v").alias("m")).collect():
        known = [Fraction(v) for v in groups[row["k"]] if v is not None and math.isfinite(v)]
        if not known:
            assert row["m"] is None
            continue
        mean = sum(known) / len(known)
        assert math.isclose(row["m"], float(mean), rel_tol=1e-15, abs_tol=2.0**-60)


def test_days_of_equal_prices_tie(spark, tmp_path):
    prices = [1001.91, 0.1, 0.2, 0.3, 33.33, 76543.21]
    rows = [(d, p) for d in range(6) for p in prices[d:] + prices[:d]]
    df = spark.createDataFrame(rows, "d int, o_totalprice double").select(F.date_add(F.lit("1996-01-01").cast("date"), F.col("d")).alias("o_orderdate"), "o_totalprice")
    df.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    assert len({r["v"] for r in frames.usage(spark, str(tmp_path)).collect()}) == 1
