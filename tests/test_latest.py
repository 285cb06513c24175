"""The table of last days equals the whole history after any order of days and replays."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from staywise.operators import history as H
from staywise.session import checkpoint_dir
from staywise.sources.latest import LatestTable
from staywise.sources.store import DailyStore

SCHEMA = "client_id long, id long, prediction_date timestamp_ntz, risk_level string"
LEVELS = ("low", "medium", "high", "critical")


def batch(spark, rows):
    return spark.createDataFrame([(c, i, t, lv) for c, i, t, lv in rows], "client_id long, id long, t string, risk_level string").select(
        "client_id", "id", F.to_timestamp_ntz("t").alias("prediction_date"), "risk_level")


def new_root(spark):
    return f"{checkpoint_dir(spark)}/latest-test-{uuid.uuid4().hex}"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("keep, seed", [(2, 1), (4, 2)])
def test_equals_the_whole_history(spark, keep, seed):
    store = DailyStore(spark, new_root(spark))
    table = LatestTable(store, keep=keep, buckets=3)
    assert table.refresh() == 0 and table.latest() is None
    rng, number = random.Random(seed), 0
    days = [3, 4, 1, 6, 6, 2, 5, 9, 7]  # out of order, one twice
    for k, day in enumerate(days):
        new = []
        for client in rng.sample(range(12), 7):
            number += 1
            new.append((client, number, f"2001-08-{day:02d} {rng.randint(0, 23):02d}:00:00", rng.choice(LEVELS)))
        new.append((None, number + 1000, f"2001-08-{day:02d} 01:00:00", "low"))
        store.upsert(batch(spark, new), f"v{k}")
        if k % 3 != 1:  # sometimes two writes wait
            table.refresh()
            whole = store.current().where("client_id IS NOT NULL")
            want = H.latest(whole, "client_id", ("prediction_day",))
            cols = ["client_id", "prediction_day", "id", "risk_level"]
            assert rows(table.latest(), *cols) == rows(want, *cols)
            ids = spark.range(14).select(F.col("id").alias("client_id"))
            for at in ("2001-08-01", "2001-08-05", "2001-08-10"):
                got = table.previous_level(ids, at)
                assert rows(got, *got.columns) == rows(H.previous_level(ids, whole, "client_id", at), *got.columns)
            kept = table.rows().groupBy("client_id").count()
            assert kept.agg(F.max("count")).first()[0] <= keep
    table.refresh()
    assert table.refresh() == 0  # nothing is pending, nothing is written
    store.upsert(batch(spark, new), "replayed")
    before = rows(table.rows(), "client_id", "prediction_day", "id", "older_")
    assert table.refresh() > 0 and rows(table.rows(), "client_id", "prediction_day", "id", "older_") == before


def test_only_the_delta_and_the_table_are_read(spark, monkeypatch):
    store = DailyStore(spark, new_root(spark))
    table = LatestTable(store, buckets=2)
    for day in range(1, 7):
        store.upsert(batch(spark, [(c, 10 * day + c, f"2001-08-{day:02d} 06:00:00", "low") for c in range(5)]), str(day))
        table.refresh()
    asked = []
    real = DailyStore.current
    monkeypatch.setattr(DailyStore, "current", lambda self, days=None: asked.append(days) or real(self, days))
    store.upsert(batch(spark, [(1, 99, "2001-08-07 06:00:00", "high")]), "7")
    asked.clear()
    assert table.refresh() == 1 and [[str(d) for d in x] for x in asked] == [["2001-08-07"]]
    asked.clear()
    new = table.previous_level(spark.createDataFrame([(1,), (2,)], "client_id long"), "2001-08-08")
    assert rows(new, "client_id", "previous_level") == [(1, "high"), (2, "low")] and asked == []
    files = {f.split("/")[-3] for f in table.rows().inputFiles()}
    assert files and not any("prediction_day" in f for f in table.rows().inputFiles())
    table.previous_level(spark.createDataFrame([(1,)], "client_id long"), "2001-08-03").collect()
    assert asked == [None]  # before all kept days: from the history


def test_interrupted_refresh_is_made_up(spark, monkeypatch):
    store = DailyStore(spark, new_root(spark))
    table = LatestTable(store, buckets=2)
    store.upsert(batch(spark, [(1, 1, "2001-08-01 06:00:00", "low")]), "a")
    monkeypatch.setattr(LatestTable, "manifest", lambda self, real=LatestTable.manifest: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.refresh()
    monkeypatch.undo()
    assert table.latest() is None
    store.upsert(batch(spark, [(1, 2, "2001-08-02 06:00:00", "high"), (2, 3, "2001-08-02 06:00:00", "low")]), "b")
    assert table.refresh() == 3 and rows(table.latest(), "client_id", "risk_level") == [(1, "high"), (2, "low")]
