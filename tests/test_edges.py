"""Edge frames (one per trap) for the scalar functions and history rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from staywise.functions import dates as D
from staywise.functions import risk as R
from staywise.functions import values as V
from staywise.operators import features as FT
from staywise.operators import history as H
from staywise.operators import metrics as M
from staywise.operators import summary as S
from staywise.operators.encode import fit_vocabulary, label_encode


def test_probability_edges(spark):
    ps = [0.0, 0.25, 0.29, 0.30, 0.40, 0.50, 0.65, 0.75, 0.85, 1.0, None, -0.1, 1.1]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    rows = df.select("p", R.risk_level("p").alias("lv"), R.risk_level("p", R.WIDE_BANDS).alias("wide"),
                     R.risk_cut("p").alias("cut"), R.risk_score("p").alias("score"),
                     R.predicted_days("p").alias("days")).collect()
    got = {r.p: r for r in rows}
    assert got[0.29].score == 28
    assert got[0.40].lv == "medium" and got[0.40].cut == "low"
    assert got[0.0].lv == "low" and got[0.0].cut is None
    assert got[0.85].lv == "critical" and got[0.65].lv == "high"
    assert got[0.75].wide == "critical" and got[0.5].wide == "high" and got[0.25].wide == "medium"
    assert got[0.30].days is None and got[0.5].days == 90 and got[1.0].days == 7
    good, bad = H.validate(df.withColumn("risk_level", R.risk_level("p")).withColumn("risk_score", R.risk_score("p")),
                           p_col="p")
    assert sorted(r.p for r in bad.filter(F.col("p").isNotNull()).collect()) == [-0.1, 1.1]
    assert bad.count() == 3 and good.count() == 10


def test_parse_dates(spark):
    vals = ["2024-01-02", "1/2/2024", "25/12/2024", "2024-01-02 10:00:00", "junk", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.d for r in df.select(D.parse_date("s").alias("d")).collect()]
    assert got == [dt.date(2024, 1, 2), dt.date(2024, 1, 2), dt.date(2024, 12, 25), dt.date(2024, 1, 2),
                   None, None, None]


def test_parse_boolean(spark):
    vals = ["Yes", " y ", "X", "TRUE", "1", "1.0", "0", "no", "TBA", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.b for r in df.select(V.parse_boolean("s").alias("b")).collect()]
    assert got == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]


def test_cadence_profiles(spark):
    vals = ["Weekly", "weekly", "Bi-Monthly", "Daily", "Quarterly", None]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    out = df.select(
        V.map_value(F.coalesce(F.col("c"), F.lit("none")), FT.FORM_CADENCE, 4, lower=True).alias("form"),
        V.map_value("c", FT.V2_CADENCE, 2).alias("v2")).collect()
    assert [r.form for r in out] == [1, 1, 2, 4, 4, 4]
    assert [r.v2 for r in out] == [3, 2, 2, 4, 2, 2]


def test_urgency_first_match(spark):
    vals = ["Immediate", "ASAP please", "1-2 weeks", "2-4 weeks", "1 week", "none", None]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r.u for r in df.select(V.first_contains("t", FT.FORM_URGENCY, 0).alias("u")).collect()]
    assert got == [3, 3, 2, 1, 2, 0, 0]


def test_tenure_bucket(spark):
    ms = [-1, 0, 3, 4, 6, 7, 12, 13, 24, 25, 999, 1000]
    df = spark.createDataFrame([(m,) for m in ms], "m int")
    got = [r.b for r in df.select(R.tenure_bucket("m").alias("b")).collect()]
    assert got == [None, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, None]


def test_clip_fills_first(spark):
    df = spark.createDataFrame([(None,), (-5,), (500,)], "x int")
    got = [r.c for r in df.select(V.clip("x", 0, 365, 30).alias("c")).collect()]
    assert got == [30, 0, 365]


@pytest.mark.parametrize("seq,expected", [
    (["low", "critical", "critical"], ["low", "high", "critical"]),
    (["low", "high", "critical"], ["low", "medium", "high"]),
    (["critical"], ["critical"]),
    (["medium", "critical"], ["medium", "high"]),
])
def test_confirm_edges(spark, seq, expected):
    rows = [(1, dt.date(2024, 1, i + 1), lv) for i, lv in enumerate(seq)]
    df = spark.createDataFrame(rows, "client_id long, prediction_day date, risk_level string")
    out = H.confirm_levels(df, "client_id").orderBy("prediction_day").collect()
    assert [r.confirmed_level for r in out] == expected


def _fold(seq):
    prev, out = None, []
    for lv in seq:
        c = lv
        if prev is not None:
            if lv == "critical" and prev not in ("critical", "high"):
                c = "high"
            elif lv == "high" and prev == "low":
                c = "medium"
        out.append(c)
        prev = c
    return out


def test_confirm_matches_sequential_fold(spark):
    import random
    rnd = random.Random(7)
    levels = ["low", "medium", "high", "critical"]
    rows, expected = [], {}
    for e in range(60):
        seq = [rnd.choice(levels) for _ in range(rnd.randint(1, 25))]
        expected[e] = _fold(seq)
        rows += [(e, dt.date(2024, 1, 1) + dt.timedelta(days=i), lv) for i, lv in enumerate(seq)]
    df = spark.createDataFrame(rows, "client_id long, prediction_day date, risk_level string")
    got = {}
    for r in H.confirm_levels(df, "client_id").orderBy("client_id", "prediction_day").collect():
        got.setdefault(r.client_id, []).append(r.confirmed_level)
    assert got == expected


def test_ties_and_upsert(spark):
    t = dt.datetime(2024, 1, 5, 10, 0)
    df = spark.createDataFrame([(1, 7, t, 0.3), (2, 7, t, 0.6)],
                               "id long, client_id long, prediction_date timestamp, churn_probability double")
    assert H.latest(df, "client_id").count() == 1
    assert H.latest(df, "client_id").first().id == 2
    assert H.latest_with_ties(df, "client_id").count() == 2
    old = spark.createDataFrame([(1, 7, dt.datetime(2024, 1, 5, 9), 0.1)],
                                "id long, client_id long, prediction_date timestamp, churn_probability double")
    new = spark.createDataFrame([(2, 7, dt.datetime(2024, 1, 5, 18), 0.2), (3, 7, dt.datetime(2024, 1, 6, 9), 0.3)],
                                "id long, client_id long, prediction_date timestamp, churn_probability double")
    up = H.upsert_daily(new, old, "client_id").orderBy("prediction_day").collect()
    assert [r.id for r in up] == [2, 3]


def test_orphans_and_vocab(spark):
    preds = spark.createDataFrame([(1, 100), (2, 999)], "id long, client_id long")
    clients = spark.createDataFrame([(100,)], "id long")
    assert [r.client_id for r in H.orphans(preds, clients, "client_id").collect()] == [999]
    train = spark.createDataFrame([("A",), ("B",)], "industry_type string")
    vocab = fit_vocabulary(train, "industry_type", "OTHER")
    score = spark.createDataFrame([("A",), ("Z",), (None,)], "industry_type string")
    out = label_encode(score, "industry_type", vocab, "code", "OTHER", unseen="OTHER", reserved_code=-1).collect()
    assert sorted((r.industry_type or "", r.code) for r in out) == [("", -1), ("A", 0), ("Z", -1)]


def test_feedback_empty(spark):
    fb = spark.createDataFrame([], "client_id long, prediction_date date, feedback_date timestamp, "
                                   "actually_churned boolean")
    r = S.feedback_summary(fb, "2024-01-31 00:00:00").first()
    assert r.total_feedback == 0 and r.false_positive_rate is None and r.actual_precision is None
    r2 = S.false_positive_rate(fb, "2024-01-31 00:00:00").first()
    assert r2.feedback_count == 0 and r2.message == "No feedback data yet"


def test_one_class_metrics(spark):
    df = spark.createDataFrame([(i, i / 10, 0) for i in range(10)], "id long, p double, y int")
    assert M.auc(df).first().auc_roc == 0.5
    m = M.metrics_from_confusion(M.confusion(df, 0.5)).first()
    assert m.precision == 0.0 and m.recall == 0.0 and m.f05 == 0.0


def test_auc_matches_brute_force(spark):
    import random
    rnd = random.Random(3)
    rows = [(i, round(rnd.random(), 2), int(rnd.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, p double, y int")
    pos = [p for _, p, y in rows if y == 1]
    neg = [p for _, p, y in rows if y == 0]
    want = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(M.auc(df).first().auc_roc - want) < 1e-12


def test_split_positions_exact(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(500)], "id long, y boolean").withColumn(
        "y", F.col("y").cast("int"))
    s = M.stratified_split(df, 0.8)
    counts = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert counts[(1, "train")] == round(167 * 0.8) and counts[(0, "train")] == round(333 * 0.8)
    for digits in (1, 2, 4):
        d = df.withColumn("_h", M.hash_order(F.col("id"), 42))
        p = M.positions(d, ["y"], "_h", "id", hex_digits=digits)
        for r in p.groupBy("y").agg(F.min("pos").alias("a"), F.max("pos").alias("b"),
                                    F.count_distinct("pos").alias("c"), F.count("*").alias("n")).collect():
            assert r.a == 0 and r.b == r.n - 1 and r.c == r.n


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    import random
    rnd = random.Random(5)
    vals = {"a": [rnd.gauss(0, 1) for _ in range(301)], "b": [float(rnd.randint(0, 9)) for _ in range(250)],
            "c": [7.0] * 40}
    rows = [(g, v) for g, vs in vals.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.p): r.q for r in M.exact_quantiles(df, "g", "v", (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    for g, vs in vals.items():
        for p in (0.0, 0.25, 0.5, 0.75, 1.0):
            assert abs(got[(g, p)] - float(np.quantile(vs, p))) < 1e-9, (g, p)


def test_latest_member_predictions(spark):
    preds = spark.createDataFrame(
    [(1, 10, dt.datetime(2024, 1, 1), 0.2), (2, 10, dt.datetime(2024, 1, 2), 0.7), (3, 11, dt.datetime(2024, 1, 2), 0.9)],
    "id long, team_member_id long, prediction_date timestamp, attrition_probability double")
    members = spark.createDataFrame([(10, "A", "B", "lead", "active", 5), (11, "C", None, "junior", "Active", None)],
                                "id long, first_name string, last_name string, role string, status string, "
                                "client_id long")
    clients = spark.createDataFrame([(5, "Acme")], "id long, name string")
    out = H.latest_member_predictions(preds, members, clients).collect()
    assert [(r.team_member_id, r.id, r.client_name) for r in out] == [(10, 2, "Acme")]


def test_explanation_reports_on_fixed_contributions(spark):
    from staywise.operators import explain as X
    long = spark.createDataFrame(
    [(1, "no_replacement", 1.0, 2.5), (1, "current_seat_count", 3.0, -1.5), (1, "geo_encoded", 2.0, 0.2),
     (1, "mystery", 0.0, 0.9), (1, "__base__", None, -3.0),
     (2, "no_replacement", 0.0, -2.0), (2, "current_seat_count", 9.0, 0.5), (2, "geo_encoded", 1.0, 0.0)],
    "id long, feature string, value double, contribution double")
    top = X.reason_text(X.top_contributions(long, 3)).orderBy("id", "rank").collect()
    assert [(r.id, r.feature) for r in top] == [(1, "no_replacement"), (1, "current_seat_count"), (1, "mystery"),
                                            (2, "no_replacement"), (2, "current_seat_count"), (2, "geo_encoded")]
    assert top[0].reason == "No replacement is being lined up" and top[0].direction == "increases_risk"
    assert top[1].reason == "Smaller engagement — lower exposure" and top[1].impact == -1.5
    assert top[2].label == "mystery" and top[2].reason == "mystery"
    g = {r.feature: r.mean_abs_contribution for r in X.global_importance(long).collect()}
    assert g == {"no_replacement": 2.25, "current_seat_count": 1.0, "geo_encoded": 0.1, "mystery": 0.9}


def test_crowded_values_spread_evenly(spark):
    """20,000 scores within 0.0001 of 0.05 and one far off: no range holds much
    more than its share, and positions and sums are exact."""
    from staywise.operators.ordering import _parts, position, running_sums
    df = spark.range(20000).select(F.col("id"), (F.lit(0.05) + F.col("id") * 5e-9).alias("score"), F.lit(1).alias("one"))
    df = df.unionByName(spark.createDataFrame([(20000, 999.0, 1)], "id long, score double, one int"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or the small parts are put together
    try:
        sizes = [r["count"] for r in _parts(df, [F.col("score")]).groupBy("part_").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(sizes) > 3 and max(sizes) < 2 * 20001 / len(sizes)
    assert position(df, [F.col("score")], "pos").filter("pos <> id").count() == 0
    r = running_sums(df, [], [F.col("score").desc()], {"above": "one"})
    assert r.filter("above <> 20000 - id").count() == 0
    r = running_sums(df.withColumn("g", F.col("id") % 3), ["g"], [F.col("score")], {"n": "one"})
    assert r.filter("n <> floor(id / 3)").count() == 0
