"""``python -m nightframe.cli DETAILS.csv [DATE]``: clusters of one day's events and what flow limitation, pressure and
EPAP did within each."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.operators import events as E
from nightframe.params import APNEA_TYPES, FLOW_TYPE, ClusterParams
from nightframe.session import session
from nightframe.sources.tabular import read_details


def report(spark: SparkSession, path: str, day: str | None, p: ClusterParams) -> DataFrame:
    details = read_details(spark, path)
    if day:
        details = details.filter(F.startswith(F.date_format("ts", "yyyy-MM-dd"), F.lit(day)))
    apneas = E.apnea_events(details, "event", "ts", "value", (), APNEA_TYPES)
    flow = E.flow_samples(details, "event", "ts", "value", (), FLOW_TYPE)
    found = E.finalize(E.clusters(apneas, flow, p), p)
    points = details.filter(F.col("event").isin(FLOW_TYPE, "Pressure", "EPAP")).select(F.col("event").alias("kind"), E.seconds("ts").alias("t"), "value")
    inside = E.within(found.select("cluster", "start", "end"), points)
    ranges = inside.groupBy("cluster").agg(*[f(F.when(F.col("kind") == k, F.col("value"))).alias(f"{n}_{k.lower()}") for k in (FLOW_TYPE, "Pressure", "EPAP") for n, f in (("min", F.min), ("max", F.max))])
    return found.join(ranges, "cluster", "left").orderBy("start")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("details")
    parser.add_argument("day", nargs="?")
    for name, kind in (("gap", float), ("bridge_gap", float), ("bridge_threshold", float), ("edge_enter", float), ("edge_exit", float), ("min_events", int), ("min_total", float), ("max_span", float)):
        parser.add_argument(f"--{name.replace('_', '-')}", type=kind, default=getattr(ClusterParams(), name))
    parser.add_argument("--algorithm", choices=("bridged", "agglomerative", "kmeans"), default="bridged")
    found = vars(parser.parse_args(arguments))
    path, day = found.pop("details"), found.pop("day")
    spark = session()
    report(spark, path, day, replace(ClusterParams(), **found)).show(100, truncate=False)


if __name__ == "__main__":
    main()
