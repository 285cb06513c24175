"""Store, export and report writers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from staywise.operators import history as H
from staywise.sources import reports as RP
from staywise.sources import store as ST


def _preds(spark, rows):
    return spark.createDataFrame(rows, "id long, client_id long, prediction_date timestamp, churn_probability double")


def test_daily_store_versions(spark, tmp_path):
    s = ST.DailyStore(spark, str(tmp_path / "store"))
    assert s.current() is None
    s.upsert(_preds(spark, [(1, 7, dt.datetime(2024, 1, 5, 9), 0.1)]), "20240130_v9")
    s.upsert(_preds(spark, [(2, 7, dt.datetime(2024, 1, 5, 18), 0.2), (3, 7, dt.datetime(2024, 1, 6, 9), 0.3)]),
             "20240130_v10")
    # the order of writing decides, not the text order of the version names
    cur = sorted((r.id, str(r.prediction_day)) for r in s.current().collect())
    assert cur == [(2, "2024-01-05"), (3, "2024-01-06")]
    # the first write's files are untouched; untouched days are not rewritten
    first = s.manifest().filter("sequence = 0").first().folder
    assert [r.id for r in spark.read.parquet(str(tmp_path / "store" / first)).collect()] == [1]
    s.upsert(_preds(spark, [(4, 8, dt.datetime(2024, 1, 7, 9), 0.4)]), "20240131_v1")
    last = s.manifest().filter("sequence = 2").first().folder
    assert [p.name for p in (tmp_path / "store" / last).glob("prediction_day=*")] == ["prediction_day=2024-01-07"]
    assert sorted(r.id for r in s.current().collect()) == [2, 3, 4]
    # writing a batch again (same version) goes to a folder of its own and changes nothing
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / last).rglob("*.parquet")}
    s.upsert(_preds(spark, [(4, 8, dt.datetime(2024, 1, 7, 9), 0.4)]), "20240131_v1")
    assert sorted(r.id for r in s.current().collect()) == [2, 3, 4]
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / last).rglob("*.parquet")}
    # another store object, as after a restart, goes on counting
    ST.DailyStore(spark, str(tmp_path / "store")).upsert(_preds(spark, [(9, 8, dt.datetime(2024, 1, 7, 10), 0.9)]), "0")
    assert sorted(r.id for r in s.current().collect()) == [2, 3, 9]


def test_daily_store_keeps_maps_and_quarantines_rows_without_a_day(spark, tmp_path):
    s = ST.DailyStore(spark, str(tmp_path / "store"))
    p = _preds(spark, [(1, 7, dt.datetime(2024, 1, 5, 9), 0.1), (2, 7, dt.datetime(2024, 1, 5, 10), 0.2), (3, 8, None, 0.3)])
    p = p.withColumn("features", F.create_map(F.lit("p"), F.col("churn_probability")))
    assert s.upsert(p, "a") == [dt.date(2024, 1, 5)]
    assert s.upsert(p.filter("id = 3"), "b") == []
    assert [(r.id, r.features) for r in s.current().collect()] == [(2, {"p": 0.2})]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "store" / "_quarantine" / "*")).collect()] == [3, 3]
    assert H.latest(p.filter("id < 3"), "client_id").first().features == {"p": 0.2}


def test_unreadable_manifest_is_an_error(spark, tmp_path):
    s = ST.DailyStore(spark, str(tmp_path / "store"))
    s.upsert(_preds(spark, [(1, 7, dt.datetime(2024, 1, 5, 9), 0.1), (2, 8, dt.datetime(2024, 1, 5, 9), 0.1)]), "1")
    (part,) = (tmp_path / "store" / "_manifest").glob("*.parquet")
    good = part.read_bytes()
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(b"PAR1 damaged PAR1")
    with pytest.raises(Exception):
        s.upsert(_preds(spark, [(3, 9, dt.datetime(2024, 1, 5, 9), 0.1)]), "2")
    part.write_bytes(good)
    assert sorted(r.id for r in s.current().collect()) == [1, 2]


def test_feedback_store(spark, tmp_path):
    s = ST.feedback_store(spark, str(tmp_path / "fb"))
    day = dt.date(2024, 1, 5)
    rows = [(7, day, dt.datetime(2024, 1, 8), False), (7, day, dt.datetime(2024, 1, 9), True), (8, day, dt.datetime(2024, 1, 9), False)]
    cols = "client_id long, prediction_date date, feedback_date timestamp, actually_churned boolean"
    s.upsert(spark.createDataFrame(rows[:1] + rows[2:], cols), "1")
    s.upsert(spark.createDataFrame(rows[1:2], cols), "2")
    assert sorted((r.client_id, r.actually_churned) for r in s.current().collect()) == [(7, True), (8, False)]


def test_export_and_latest_file(spark, tmp_path):
    a = spark.range(5).withColumn("x", F.col("id") * 2)
    empty = spark.range(0)
    meta = ST.export_all({"a": a, "empty": empty}, str(tmp_path / "out"), "csv")
    assert meta == {"a": 5}
    (part,) = (tmp_path / "out" / "_metadata").glob("*.json")
    docs = [json.loads(x) for x in part.read_text().splitlines()]
    assert sorted((d["dataset"], d["rows"], d["columns"]) for d in docs) == [("a", 5, ["id", "x"]), ("empty", 0, ["id"])]
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "a"))
    assert back.count() == 5
    ST.export_all({"a": a}, str(tmp_path / "js"), "json")
    assert spark.read.json(str(tmp_path / "js" / "a")).count() == 5
    (tmp_path / "p1.csv").write_text("a\n1\n")
    (tmp_path / "p2.csv").write_text("a\n2\n")
    import os
    os.utime(tmp_path / "p1.csv", (1, 1))
    assert ST.latest_file(spark, str(tmp_path / "p*.csv")).endswith("p2.csv")


def test_run_log_and_model_run(spark, tmp_path):
    p = _preds(spark, [(1, 7, dt.datetime(2024, 1, 5), 0.9), (2, 8, dt.datetime(2024, 1, 5), 0.5),
                       (3, 9, dt.datetime(2024, 1, 5), 0.1)])
    r = ST.run_log(H.score_levels(p), "m", "v", "2024-01-05 00:00:00", "2024-01-05 00:01:30").first()
    assert (r.total_predictions, r.high_risk_count, r.medium_risk_count, r.low_risk_count) == (3, 1, 1, 1)
    assert r.duration_seconds == 90 and r.status == "completed"
    imp = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "feature string, importance double")
    run = RP.model_run_row(spark, "churn", "v1", {"accuracy": 0.9, "auc_roc": 0.8}, imp, {"maxDepth": 4})
    RP.append_model_run(run, str(tmp_path / "runs"))
    back = spark.read.parquet(str(tmp_path / "runs")).first()
    assert back.feature_importance == {"a": 0.75, "b": 0.25} and back.hyperparameters == {"maxDepth": "4"}
    RP.write_explanations(spark.createDataFrame([(1, "a", 0.5)], "id long, feature string, contribution double"),
                          imp, spark.createDataFrame([("low", 1)], "risk_level string, n long"),
                          str(tmp_path / "expl"), {"model": "churn"})
    assert spark.read.text(str(tmp_path / "expl" / "per_entity_json")).count() == 1


def test_prediction_files_by_instant(spark, tmp_path):
    p = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.5)], "client_id long, churn_probability double")
    folder = str(tmp_path / "exports")
    path = ST.export_predictions(p, folder, "2024-02-01 06:00:00")
    assert path.endswith("/predictions_20240201_060000.csv")
    ST.export_predictions(p.limit(1), folder, "2024-01-31T23:59:59")
    ST.export_predictions(p, folder, "2024-02-01 06:00:00")  # again
    assert [r["client_id"] for r in ST.latest_predictions(spark, folder).collect()] == ["2", "3", "1"]
    (tmp_path / "none").mkdir()
    assert ST.latest_predictions(spark, str(tmp_path / "none")) is None


def test_training_files_are_typed(spark, tmp_path):
    from staywise.sources import ingest as I
    (tmp_path / "clients.csv").write_text("id, name ,is_active,start_date,extra\n1,Acme,true,2024-01-02 03:04:05,x\nx,Beta,maybe,soon,\n")
    (tmp_path / "team_members.csv").write_text("id,role,client_id\n7,manager,\n")
    clients, members = I.load_training_files(spark, str(tmp_path))
    assert dict(clients.dtypes) == I.CLIENT_FILE and dict(members.dtypes) == I.MEMBER_FILE
    a, b = clients.collect()
    assert (a["id"], a["name"], a["is_active"], str(a["start_date"])) == (1, "Acme", True, "2024-01-02 03:04:05")
    assert (b["id"], b["name"], b["is_active"], b["start_date"]) == (None, "Beta", None, None)
    assert members.first()["client_id"] is None and members.first()["status"] is None
    import pytest
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        I.load_training_files(spark, str(tmp_path / "nowhere"))
