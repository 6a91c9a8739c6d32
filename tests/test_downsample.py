"""Bucket means of a series are those of its samples in order of time."""

from nightframe.operators import wearable as N


def test_downsample_adds_in_order_of_time(spark):
    # in order of time 91.89 + 26.9 + 5.71 is a little less than 124.5, and the five values are 227.5; other orders give others
    values = {1: [91.89, 26.9, 5.71], 2: [19.82, 18.34, 136.38, 39.07, 13.89]}
    for turn in range(5):
        points = [(u, 0.0 + i, v) for u, vs in values.items() for i, v in enumerate(vs)]
        df = spark.createDataFrame(points[turn:] + points[:turn] + [(3, 1.0, None)], "u int, sec double, v double").repartition(3, "sec")
        got = {r["u"]: r["values"] for r in N.downsample(df, "v", 60, ["u"]).collect()}
        assert got == {1: [41], 2: [46], 3: [None]}
