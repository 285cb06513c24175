"""Invariants of the model operators, explanations and streaming twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staywise.operators import explain as X
from staywise.operators import metrics as M
from staywise.operators import model as MO
from staywise.plans import q_model as QM
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def fitted(spark):
    tm = QM.churn_training(spark, SF_SMALL).cache()
    m = MO.fit_boosted(tm, QM.FT.TRAINING_MATRIX_12, "client_lost", {"maxIter": 5, "maxDepth": 3})
    return tm, m


def test_importances_sum_to_one(spark, fitted):
    tm, m = fitted
    imp = MO.feature_importances(spark, m, QM.FT.TRAINING_MATRIX_12).collect()
    assert len(imp) == 12 and abs(sum(r.importance for r in imp) - 1.0) < 1e-9


def test_scores_in_range(spark, fitted):
    tm, m = fitted
    s = MO.score(tm, m, ["id"]).agg(F.min("churn_probability"), F.max("churn_probability")).first()
    assert 0.0 <= s[0] <= s[1] <= 1.0


def test_explanations_add_up_to_margin(spark, fitted):
    tm, m = fitted
    long = X.explain(spark, tm, m, QM.FT.TRAINING_MATRIX_12)
    sums = long.groupBy("id").agg(F.sum("contribution").alias("s"))
    margin = MO.margin(m.transform(tm.withColumn("client_lost", F.col("client_lost").cast("double")))).select(
        "id", "margin")
    diff = sums.join(margin, "id").select(F.max(F.abs(F.col("s") - F.col("margin")))).first()[0]
    assert diff < 1e-6


def test_shapley_brute_force_single_tree():
    # one depth-2 tree on 2 features, checked against the subset definition
    trees = [(1.0, [(1.0, [(0, 0.5, True, 0.4), (1, 0.5, True, 0.5)]), (2.0, [(0, 0.5, True, 0.4), (1, 0.5, False, 0.5)]),
                    (3.0, [(0, 0.5, False, 0.6)])])]
    X_ = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    phi, base = X.shap_batch(X_, trees)
    assert abs(base - (0.4 * 0.5 * 1 + 0.4 * 0.5 * 2 + 0.6 * 3)) < 1e-12
    pred = np.array([1.0, 2.0, 3.0])
    assert np.allclose(phi.sum(axis=1) + base, pred)


def test_calibrated_probabilities(spark, fitted):
    tm, _ = fitted
    cal = MO.calibrate(tm, QM.FT.TRAINING_MATRIX_12, "client_lost", 3, {"maxIter": 3, "maxDepth": 2})
    s = MO.score(tm, cal, ["id"])
    r = s.agg(F.min("churn_probability"), F.max("churn_probability"), F.count("*")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] == tm.count()


def test_fit_guard(spark):
    df = spark.createDataFrame([(i, 0) for i in range(20)], "id long, y int")
    with pytest.raises(ValueError):
        MO.fit_guard(df, "y")
    ok = MO.fit_guard(spark.createDataFrame([(i, i % 2) for i in range(8)], "id long, y int"), "y")
    assert ok["warnings"]


def test_stream_confirm_late_row(spark, tmp_path):
    import datetime as dt
    from staywise.streaming import jobs as J
    src = tmp_path / "src"
    rows1 = [(1, dt.date(2024, 1, d), lv) for d, lv in ((1, "low"), (2, "critical"), (3, "critical"))]
    spark.createDataFrame(rows1, "client_id long, prediction_day date, risk_level string").coalesce(1) \
        .write.parquet(str(src / "00001"))
    late = [(1, dt.date(2024, 1, 2), "low")]
    spark.createDataFrame(late, "client_id long, prediction_day date, risk_level string").coalesce(1) \
        .write.parquet(str(src / "00002"))
    out = J.run_confirm(spark, str(src / "*"), str(tmp_path / "out"), str(tmp_path / "ck"), max_files=1)
    got = sorted(((r.prediction_day.day, r.confirmed_level, r.late) for r in out.collect()),
                 key=lambda t: (t[0], t[2]))
    assert got == [(1, "low", False), (2, "high", False), (2, None, True), (3, "critical", False)]


def test_scale_pos_weight(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(12)], "id long, y int")
    w = {r.id: r.weight for r in MO.with_scale_pos_weight(df, "y").collect()}
    assert w[0] == 3.0 and w[5] == 1.0
    # balanced: positive weight mass equals negative mass
    assert sum(v for k, v in w.items() if k < 3) == sum(v for k, v in w.items() if k >= 3)


def test_stream_features_idempotent(spark, tmp_path):
    from staywise.sources import adapters as A
    from staywise.streaming import jobs as J
    t = A.terminations(spark, SF_SMALL)
    t.repartition(3).write.parquet(str(tmp_path / "src"))
    for run in ("a", "b"):  # the second run replays every row into the same table
        s = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
        J.stream_features(s, str(tmp_path / "feat"), str(tmp_path / f"ck{run}")).awaitTermination()
    f = spark.read.parquet(str(tmp_path / "feat"))
    assert f.count() == t.count() == f.select("termination_id").distinct().count()


def test_stream_features_with_null_dates_replayed(spark, tmp_path):
    """Rows without a notice date are stored once, however often they come."""
    from staywise.sources import adapters as A
    from staywise.streaming import jobs as J
    t = A.terminations(spark, SF_SMALL).orderBy("id").limit(20)
    t = t.withColumn("notice_date", F.when(F.col("id") % 2 == 0, F.col("notice_date")))
    t.coalesce(1).write.parquet(str(tmp_path / "src"))
    for run in range(3):
        s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "src"))
        J.stream_features(s, str(tmp_path / "feat"), str(tmp_path / f"ck{run}")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "feat"))
    assert got.count() == 20 and got.select("termination_id").distinct().count() == 20
    # the stored ids are looked up in the batch's months only
    ids = J.stored_ids(spark, str(tmp_path / "feat"), ["none"])
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "none" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_feedback_days_replayed(spark, tmp_path):
    from staywise.streaming import jobs as J
    rows = [(1, f"2024-01-0{d} 0{h}:00:00", h % 2 == 0) for d in (1, 2, 5) for h in range(4)]
    fb = spark.createDataFrame(rows, "client_id long, d string, actually_churned boolean").withColumn(
        "feedback_date", F.to_timestamp_ntz("d")).drop("d")
    fb.coalesce(1).write.parquet(str(tmp_path / "src"))
    for run in range(2):
        s = spark.readStream.schema(fb.schema).parquet(str(tmp_path / "src"))
        J.stream_feedback_days(s, str(tmp_path / "days"), str(tmp_path / f"ck{run}")).awaitTermination()
    days = spark.read.parquet(str(tmp_path / "days"))
    assert sorted((str(r.day), r.total_feedback, r.true_positives) for r in days.collect()) == [
        ("2024-01-01", 4, 2), ("2024-01-02", 4, 2), ("2024-01-05", 4, 2)]
    w = {str(r.window_start)[:10]: r.total_feedback for r in J.feedback_windows(days, 3).collect()}
    assert w == {"2023-12-30": 4, "2023-12-31": 8, "2024-01-01": 8, "2024-01-02": 4, "2024-01-03": 4, "2024-01-04": 4, "2024-01-05": 4}


def test_bundle_of_a_calibrated_model(spark, fitted, tmp_path):
    """Members, sigmoids and vocabularies come back; the last save is the latest, whatever its name."""
    tm, m = fitted
    root = str(tmp_path / "models")
    cal = MO.calibrate(tm, QM.FT.TRAINING_MATRIX_12, "client_lost", 2, {"maxIter": 2, "maxDepth": 2})
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "value string, code long")
    MO.save(m, {"threshold": 0.5}, root, "v9")
    MO.save(cal, {"threshold": 0.4}, root, "v10", {"geo": vocab})
    got, meta, version = MO.load(root)
    assert version == "v10" and meta["threshold"] == 0.4 and len(got.members) == 2
    both = got.transform(tm, out="p").select("id", "p").join(cal.transform(tm, out="q").select("id", "q"), "id")
    assert both.filter(F.abs(F.col("p") - F.col("q")) > 1e-12).count() == 0
    assert MO.load_vocabulary(root, version, "geo").count() == 2
    assert MO.load(root, "v9")[1]["calibrated"] is False
    with pytest.raises(FileNotFoundError):
        MO.load(root, "v11")
    with pytest.raises(FileNotFoundError):
        MO.load(str(tmp_path / "none"))


def test_members_outside_the_tenure_buckets_are_returned(spark, monkeypatch):
    """Months -1 and 1000 have no bucket, 0 and 999 have one; all four are active."""
    import datetime as dt
    ref, days = dt.date(2001, 8, 2), {9001: -30, 9002: -29, 9003: 29999, 9004: 30000}
    members = QM.A.team_members(spark, SF_SMALL)
    types = dict(members.dtypes)
    extra = spark.createDataFrame([(i, ref - dt.timedelta(days=d)) for i, d in days.items()], "id long, day date")
    extra = extra.select(*[F.lit("Active").alias(c) if c == "status" else F.col("id") if c == "id" else F.lit(1).cast(types[c]).alias(c) if c == "client_id"
                           else F.col("day").cast(types[c]).alias(c) if c in ("start_date", "created_at", "updated_at")
                           else F.lit("senior").alias(c) for c in members.columns])
    both = members.unionByName(extra)
    monkeypatch.setattr(QM.A, "team_members", lambda *a: both)
    w = MO.with_balanced_weights(QM.member_rows(spark, SF_SMALL)[0], "left")
    model = MO.fit_boosted(w, list(QM.FT.MEMBER_FEATURES), "left", {"maxIter": 2, "maxDepth": 2}, weight_col="weight")
    monkeypatch.setattr(QM, "member_model", lambda *a: model)
    got = {r["id"]: r for r in QM.score_members(spark, SF_SMALL).collect()}
    assert set(got) == {r["id"] for r in both.where("lower(status) = 'active'").collect()}
    assert all((got[i]["attrition_probability"] is None) == (i in (9001, 9004)) for i in days)
    for i in (9001, 9004):
        assert got[i]["unscored_reason"] and got[i]["risk_level"] is None and got[i]["risk_score"] is None
    assert got[9002]["unscored_reason"] is None
    assert {9001, 9004} <= {r["id"] for r in QM.member_recommendations(spark, SF_SMALL).collect()}
    total = QM.member_risk_summary(spark, SF_SMALL).first()
    assert total["total_team_members"] == len(got) and total["unscored_team_members"] == sum(r["unscored_reason"] is not None for r in got.values())


def test_class_weights_are_sent_to_the_rows(spark):
    """joined by the label, half of all rows would be read by one task."""
    df = spark.createDataFrame([(i, i % 3 // 2) for i in range(30)], "id long, y int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = MO.with_scale_pos_weight(df, "y")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r["y"], r["weight"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert got == {(0, 1.0), (1, 2.0)}


def test_explained_cases_of_a_leaf_are_those_of_its_rows():
    """A row looks up its case; equal to adding up all orders of the features."""
    from itertools import permutations
    from math import factorial
    path = [(0, 0.5, True, 0.25), (2, 1.0, False, 0.5), (0, 0.2, False, 0.75), (1, 3.0, True, 0.125)]
    rows = np.array([[a, b, c] for a in (0.1, 0.3, 0.9) for b in (1.0, 4.0) for c in (0.0, 2.0)])
    (feats, terms), = X.leaf_terms([(0.5, [(2.0, path)])])[0]
    assert terms.shape == (3, 8)
    phi, base = X.shap_batch(rows, [(0.5, [(2.0, path)])])
    z = {0: 0.25 * 0.75, 2: 0.5, 1: 0.125}
    for row, got in zip(rows, phi):
        o = {0: row[0] <= 0.5 and row[0] > 0.2, 2: row[2] > 1.0, 1: row[1] <= 3.0}
        want = np.zeros(3)
        for order in permutations(z):
            value = np.prod(list(z.values()))
            for f in order:
                after = value / z[f] * o[f]
                want[f] += (after - value) / factorial(3)
                value = after
        assert np.allclose(got, want)
    assert np.isclose(base, 0.25 * 0.75 * 0.5 * 0.125)


def test_rows_of_a_fit_are_dealt_evenly(spark, monkeypatch):
    """two tasks a core, whatever partitions the rows come in."""
    from staywise import session
    monkeypatch.setattr(session, "EVEN_ROWS", 1000)
    df = spark.range(0, 2000, 1, 1)
    parts = session.evenly(df, 2000).rdd.glom().map(len).collect()
    assert len(parts) == 2 * spark.sparkContext.defaultParallelism and max(parts) - min(parts) <= 1
    assert session.evenly(df, 999).rdd.getNumPartitions() == 1
    assert MO._at_once(spark, 10, 5) == 5
    assert MO._at_once(spark, MO.ROWS_PER_CORE * spark.sparkContext.defaultParallelism, 5) == 1
