"""Clusters from a stream: those of the batch form, in any order of arrival, over restarts, and late events counted."""

import random

import pytest
from pyspark.sql import functions as F

from nightframe.operators import events as E
from nightframe.sources import store
from nightframe.streaming import ingest, sessions

SCHEMA = "who string, ts timestamp, dur double"


def made(seed):
    rnd = random.Random(seed)
    rows = []
    for who in ("a", "b", "c"):
        t = 1_700_000_000.0
        for _ in range(60):
            t += rnd.choice([5, 20, 40, 300])
            rows.append((who, t, float(rnd.choice([0, 10, 60]))))
    return sorted(rows, key=lambda r: r[1])


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "who string, t double, dur double").select("who", F.timestamp_seconds("t").alias("ts"), "dur").coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, late="30 seconds"):
    stream = sessions.read_events(spark, str(tmp_path / "in"), SCHEMA, files_at_once=1)
    return sessions.run_through(sessions.stream_clusters(stream, "ts", "dur", ["who"], 30.0, late), str(tmp_path / "out"), str(tmp_path / "state"))


def found(spark, tmp_path):
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("who <> 'end'").select("who", "cluster", "start", "end", "count", "total_sec").collect())


def batch(spark, rows):
    events = spark.createDataFrame(rows, "who string, t double, dur double")
    out = E.summarize_clusters(E.gap_clusters(events, 30.0, ["who"]), ["who"])
    return sorted(tuple(r) for r in out.select("who", "cluster", "start", "end", "count", "total_sec").collect())


END = [[("end", 2e9, 0.0)], [("end", 2.1e9, 0.0)]]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_same_as_batch_over_a_restart(spark, tmp_path):
    """Files in order of time, rows within a file in none; the second run goes on with the state of the first."""
    rows = made(1)
    for k in range(0, 90, 45):
        arrive(spark, str(tmp_path / "in"), random.Random(k).sample(rows[k : k + 45], 45))
    run(spark, tmp_path)
    early = found(spark, tmp_path)
    assert early and set(early) < set(batch(spark, rows))
    for part in (rows[90:], *END):
        arrive(spark, str(tmp_path / "in"), part)
    query = run(spark, tmp_path)
    assert found(spark, tmp_path) == batch(spark, rows) and sessions.late_events(query) == 0


def test_late_events_are_counted(spark, tmp_path):
    rows = made(2)
    for part in (rows[60:120], rows[120:], rows[:10], *END):
        arrive(spark, str(tmp_path / "in"), part)
    query = run(spark, tmp_path)
    assert sessions.late_events(query) == 10 and found(spark, tmp_path) == batch(spark, rows[60:])


def test_nightly_counts(spark, tmp_path):
    rows = made(3)
    for part in (rows, *END):
        arrive(spark, str(tmp_path / "in"), part)
    days = sessions.stream_nightly(sessions.read_events(spark, str(tmp_path / "in"), SCHEMA, 1), "ts", "dur")
    sessions.run_through(days, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {str(r["day"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sum(n for d, n in got.items() if d < "2030") == len(rows)


def test_growing_export_is_read_once(spark, tmp_path):
    """A second run reads only new files; bad rows are counted, denied files never opened, later files win."""
    root, out, state = tmp_path / "Takeout folder", str(tmp_path / "store"), str(tmp_path / "ingest")

    def put(name, text):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    put("Oxygen Saturation (SpO2)/Minute SpO2 - 2024-01-01.csv", "timestamp,value\n2024-01-01T01:00:00Z,95\n2024-01-01T01:01:00Z,bad\n2024-01-01T01:02:00Z,93\n")
    put("Global Export Data/steps-2024-01-01.json", '[{"dateTime": "01/01/24 08:00:00", "value": "10"}, {"dateTime": "01/01/24 09:00:00", "value": "5"}]')
    put("Account/Minute SpO2 - 2024-01-01.csv", "timestamp,value\n2024-01-01T09:00:00Z,1\n")
    put("Sleep Score/sleep_score.csv", "sleep_log_entry_id,overall_score\n7,80\n,5\n")
    first = ingest.ingest_stream(spark, str(root), out, state)
    put("Oxygen Saturation (SpO2)/Minute SpO2 - 2024-01-02.csv", "timestamp,value\n2024-01-01T01:02:00Z,90\n2024-01-03T01:00:00Z,97\n")
    put("Global Export Data/steps-2024-01-31.json", '[{"dateTime": "01/01/24 10:00:00", "value": "1"}, {"dateTime": "01/31/24 10:00:00", "value": "2"}]')
    second = ingest.ingest_stream(spark, str(root), out, state)
    rows_in = lambda q: sum(p["numInputRows"] for p in q.recentProgress)
    assert rows_in(first) == 4 and rows_in(second) == 2
    held = {r["value"] for r in store.read_store(spark, f"{out}/spo2_minute").collect()}
    assert held == {95.0, 90.0, 97.0}
    assert {(str(r["night"]), r["steps"]) for r in ingest.nightly_sums(spark, out, "steps").collect()} == {("2024-01-01", 16.0), ("2024-01-31", 2.0)}
    bad = {(r["metric"], r["malformed"], r["rows"]) for r in ingest.malformed_files(spark, out).collect()}
    assert bad == {("spo2_minute", 1, 3), ("spo2_minute", 0, 2), ("steps", 0, 2), ("sleep_score", 1, 2)}
    marks = ingest.marks(spark, out)
    assert {(r["metric"], str(r["high_water"])) for r in marks.collect()} == {("spo2_minute", "2024-01-03"), ("steps", "2024-01-31")}
    assert str(store.lowest_mark(marks).first()["high_water"]) == "2024-01-03"
    third = ingest.ingest_stream(spark, str(root), out, state)
    assert rows_in(third) == 0
