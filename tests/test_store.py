"""The keyed store: all of an upsert or nothing of it."""

import pytest
from pyspark.sql import functions as F

from nightframe.operators import engine
from nightframe.sources import export_tree, store


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "nights")


def frame(spark, rows, columns="night string, v int"):
    return spark.createDataFrame(rows, columns).withColumn("night", F.col("night").cast("date"))


def held(spark, path):
    return {(str(r["night"]), r["v"]) for r in store.read_store(spark, path).collect()}


FIRST = [("2021-01-01", 1), ("2021-01-02", 2), ("2021-02-01", 3), (None, 4)]
SECOND = [("2021-01-02", 9), ("2021-02-01", 8), ("2021-03-05", 7), (None, 6)]


def test_replaces_and_adds(spark, path):
    store.upsert(spark, path, frame(spark, FIRST), ["night"])
    store.upsert(spark, path, frame(spark, SECOND), ["night"])
    assert held(spark, path) == {("2021-01-01", 1), ("2021-01-02", 9), ("2021-02-01", 8), ("2021-03-05", 7), ("None", 6)}


@pytest.mark.parametrize("at", ["between months", "before the state", "in the rename"])
def test_a_run_that_is_broken_off_changes_nothing(spark, path, monkeypatch, at):
    store.upsert(spark, path, frame(spark, FIRST), ["night"])
    before = held(spark, path)
    with monkeypatch.context() as m:
        if at == "between months":
            rows = frame(spark, SECOND).withColumn("v", F.when(F.month("night") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("int"))
        else:
            rows = frame(spark, SECOND)

            def lost(*_):
                raise OSError("lost")

            m.setattr(store, "write_text" if at == "before the state" else "claim", lost)
        with pytest.raises(Exception, match="lost"):
            store.upsert(spark, path, rows, ["night"], order=["night"])
    assert held(spark, path) == before
    store.upsert(spark, path, frame(spark, SECOND), ["night"])
    now = held(spark, path)
    assert ("2021-02-01", 8) in now and ("2021-01-01", 1) in now
    store.tidy(spark, path)
    assert held(spark, path) == now


def test_two_writers(spark, path, monkeypatch):
    """One commits while the other has merged with the state before; the latter merges again."""
    store.upsert(spark, path, frame(spark, FIRST), ["night"])
    commit, turns = store._commit, []

    def between(spark_, path_, number, state):
        if not turns:
            turns.append(number)
            store.upsert(spark, path, frame(spark, [("2021-01-03", 5)]), ["night"])
        return commit(spark_, path_, number, state)

    monkeypatch.setattr(store, "_commit", between)
    store.upsert(spark, path, frame(spark, SECOND), ["night"])
    assert {("2021-01-03", 5), ("2021-01-02", 9), ("2021-01-01", 1)} <= held(spark, path)


def test_readers_keep_their_state_and_tidy_removes_old_ones(spark, path, tmp_path):
    store.upsert(spark, path, frame(spark, FIRST), ["night"])
    reader = store.read_store(spark, path)
    store.upsert(spark, path, frame(spark, SECOND), ["night"])
    assert {r["v"] for r in reader.collect()} == {1, 2, 3, 4}
    store.upsert(spark, path, frame(spark, [("2021-01-01", 1), ("2021-02-02", 1), ("2021-03-03", 1), (None, 1)]), ["night"])
    store.tidy(spark, path)
    assert len(list((tmp_path / "nights").glob("version=*"))) == 1 and len(list((tmp_path / "nights/states").glob("*.json"))) == 1
    assert len(held(spark, path)) == 7


def test_columns_may_be_added_and_months_left_unread(spark, path):
    store.upsert(spark, path, frame(spark, FIRST), ["night"])
    store.upsert(spark, path, frame(spark, [("2021-02-01", 3, "x"), ("2021-02-09", 4, "y")], "night string, v int, note string"), ["night"])
    rows = {str(r["night"]): r["note"] for r in store.nights_between(spark, path, "2021-01-01", "2021-12-31").collect()}
    assert rows == {"2021-01-01": None, "2021-01-02": None, "2021-02-01": "x", "2021-02-09": "y"}
    assert len(store.nights_between(spark, path, "2021-02-01", "2021-02-28").inputFiles()) == len([f for f in store.read_store(spark, path).inputFiles() if "month=2021-02" in f])
    store.upsert(spark, path + "2", frame(spark, []), ["night"])
    assert store.read_store(spark, path + "2").count() == 0
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, path + "3")
    store.clear_all(spark, path)
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, path)


def test_listing_of_an_export(spark, tmp_path):
    """Files that may be read, files that nothing names, and denied ones."""
    for name in (
        "Global Export Data/sleep-2024-01-01.json", "Global Export Data/sleep-latest.json", "Global Export Data/heart_rate-2024-01-01.json", "Sleep Score/sleep_score.csv", "Sleep Score/gps_location_1.csv",
        "Account/sleep_score.csv", "Menstrual Health/a.csv", "Oxygen Saturation (SpO2)/Minute SpO2 - 1.csv", "Stress Score/Stress Score.csv", "Stress Score/deep/Stress Score.csv", "Your Profile/Sleep Score/sleep_score.csv",
    ):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).touch()
    found = export_tree.enumerate_export(spark, str(tmp_path))
    assert {(f.relative, f.kind.metric, f.kind.phase) for f in found} == {
        ("Global Export Data/sleep-2024-01-01.json", "sleep", "windows"), ("Sleep Score/sleep_score.csv", "sleep_score", "windows"), ("Oxygen Saturation (SpO2)/Minute SpO2 - 1.csv", "spo2_minute", "series"),
        ("Global Export Data/heart_rate-2024-01-01.json", "heart_rate", "series"), ("Stress Score/Stress Score.csv", "stress", "windows"),
    }
    assert export_tree.scan_summary(found)["sleep"] == 1


def test_registry_of_pairs(spark):
    rows = engine.registry(spark).collect()
    assert [r["pair_id"] for r in rows] == list(range(1, 13)) and {r["family"] for r in rows} == {"primary", "exploratory"}
    assert {r["pair_id"] for r in rows if r["two_sided"]} == {5, 8}
