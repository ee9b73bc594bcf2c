import os

import pytest
from pyspark.sql import functions as F

from vigil.operators import records
from vigil.sources import store


def frame(spark, *ids):
    rows = [(f"INC-{i}", f"2024-0{1 + i % 2}-15 10:00:00") for i in ids]
    return spark.createDataFrame(rows, "incident_id string, at string").select("incident_id", F.to_timestamp("at").alias("submitted_at"))


def ids(df):
    return sorted(r.incident_id for r in df.collect())


def test_a_run_counts_once(spark, tmp_path):
    path, rows = str(tmp_path / "t"), frame(spark, 1, 2)
    assert store.read(spark, path, rows.schema).count() == 0 and store.manifest(spark, path).count() == 0
    assert records.store_alerts(rows, path, "run-1") is True
    assert records.store_alerts(rows, path, "run-1") is False
    assert records.store_alerts(frame(spark, 9), path, "run-1") is False  # an entry is never changed
    assert records.store_alerts(frame(spark, 3), path, "run-2") is True
    back = store.read(spark, path, rows.schema)
    assert ids(back) == ["INC-1", "INC-2", "INC-3"] and {r.run for r in back.collect()} == {"run-1", "run-2"}


def test_an_attempt_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), frame(spark, 1, 2)
    commit = store._commit
    monkeypatch.setattr(store, "_commit", lambda *x: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        records.store_incidents(rows, path, "a")
    monkeypatch.setattr(store, "_commit", commit)
    assert store.read(spark, path, rows.schema, True).count() == 0
    assert records.store_incidents(rows, path, "a")
    back = store.read(spark, path, rows.schema, True)
    assert ids(back) == ["INC-1", "INC-2"] and {r.month_part for r in back.collect()} == {"2024-01", "2024-02"}
    assert [r.n for r in store.left_over(spark, path, rows.schema).collect()] == [2]


def test_of_two_attempts_at_once_one_counts(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), frame(spark, 1)
    commit, other = store._commit, []

    def late(*x):  # another attempt is committed while this one has written its rows
        if not other:
            other.append(True)
            assert store.store(rows, path, "a")
        return commit(*x)

    monkeypatch.setattr(store, "_commit", late)
    assert store.store(rows, path, "a") is False
    assert ids(store.read(spark, path, rows.schema)) == ["INC-1"]


def test_an_entry_that_was_never_finished_is_made_again(spark, tmp_path):
    path, rows = str(tmp_path / "t"), frame(spark, 1)
    os.makedirs(f"{path}/manifest")
    open(f"{path}/manifest/a.json", "w").close()
    assert store.read(spark, path, rows.schema).count() == 0
    assert store.store(rows, path, "a") and ids(store.read(spark, path, rows.schema)) == ["INC-1"]


def test_empty_runs_and_names(spark, tmp_path):
    path, rows = str(tmp_path / "t"), frame(spark, 1)
    assert store.store(rows.limit(0), path, "none") and not store.store(rows, path, "none")
    assert store.read(spark, path, rows.schema).count() == 0
    with pytest.raises(ValueError):
        store.store(rows, path, "../up")
