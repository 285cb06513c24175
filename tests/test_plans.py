"""Plan shape: the scale properties the operators promise."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from staywise.operators import features as FT
from staywise.operators import history as H
from staywise.operators import metrics as M
from staywise.operators import summary as S
from tests.conftest import SF_SMALL

ORACLE_NAMES = sorted(E.oracle_sql())
STREAMING = {"stream_confirm", "stream_confirm_any_order", "stream_upsert", "stream_features", "stream_feedback"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in ORACLE_NAMES if n not in STREAMING])
def test_no_pair_explosion(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_latest_is_partial_aggregation(spark):
    p = E.queries()["one_per_day_upsert"](spark, SF_SMALL)
    plan = p._jdf.queryExecution().optimizedPlan().toString() + _plan(p)
    assert "Window" not in _plan(p)
    assert "partial_max" in _plan(p)


def test_scan_pruning(spark):
    plan = _plan(E.queries()["form_features"](spark, SF_SMALL))
    line = [ln for ln in plan.splitlines() if "lineitem" in ln][0]
    assert "l_quantity" not in line and "l_extendedprice" not in line


def _hot_predictions(spark, n=3000, seed=11):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        client = 1 if i % 3 == 0 else rnd.randint(2, 60)       # client 1 holds a third of all rows
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20))
        rows.append((i, client, ts, rnd.random()))
    return rows, spark.createDataFrame(rows, "id long, client_id long, prediction_date timestamp, "
                                              "churn_probability double")


def test_hot_key_latest_and_daily(spark):
    rows, df = _hot_predictions(spark)
    want = {}
    for r in rows:
        if r[1] not in want or (r[2], r[0]) > (want[r[1]][2], want[r[1]][0]):
            want[r[1]] = r
    got = {r.client_id: r.id for r in H.latest(df, "client_id").collect()}
    assert got == {k: v[0] for k, v in want.items()}
    daily = {}
    for r in rows:
        k = (r[1], r[2].date())
        if k not in daily or (r[2], r[0]) > (daily[k][2], daily[k][0]):
            daily[k] = r
    got_d = {(r.client_id, r.prediction_day): r.id for r in H.one_per_day(df, "client_id").collect()}
    assert got_d == {k: v[0] for k, v in daily.items()}


def test_hot_key_high_risk_and_auc(spark):
    rows, df = _hot_predictions(spark)
    df = H.score_levels(df)
    hr = {r.client_id: r.max_probability for r in S.high_risk_clients(df, 0.5).collect()}
    want = {}
    for r in rows:
        if r[3] >= 0.5:
            want[r[1]] = max(want.get(r[1], 0.0), r[3])
    assert hr == want
    sc = df.select(F.col("id"), F.round("churn_probability", 2).alias("p"),
                   (F.col("client_id") == 1).cast("int").alias("y"))
    pts = [(r.p, r.y) for r in sc.collect()]
    pos = [p for p, y in pts if y == 1]
    neg = [p for p, y in pts if y == 0]
    brute = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(M.auc(sc).first().auc_roc - brute) < 1e-12


def test_form_texts_and_dates_are_converted_once(spark):
    """a text is lower-cased once a row, not once a comparison, and dates are
    subtracted by their day numbers."""
    d = dt.date
    rows = [(1, "GOOD", "Bi-Weekly", "Yes", "Within ASAP", "x", "no", d(2001, 3, 5), d(2001, 3, 1), d(2001, 3, 7), d(2000, 1, 1), d(2001, 1, 1), d(1999, 3, 5)),
            (2, None, None, None, None, None, None, d(2001, 3, 5), None, None, None, None, None),
            (3, "none", "daily", "0", "", "1", "TRUE ", None, d(9999, 12, 31), d(1, 1, 1), d(1, 1, 1), d(9999, 12, 31), None)]
    names = "health_text string, check_in_cadence string, will_have_replacement string, replacement_timeframe string, pip_implemented string, relief_offered string"
    dates = "notice_date, last_comm_date, last_checkin_date, tm_start_date, tm_last_date, client_start_date".split(", ")
    df = spark.createDataFrame(rows, f"id long, {names}, " + ", ".join(f"{c} date" for c in dates))
    out = FT.form_features(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "timestampdiff" not in plan
    for c in ("health_text", "check_in_cadence", "replacement_timeframe"):
        assert plan.count(f"lower(coalesce({c}#") == 1 and plan.count(f"lower({c}#") == 0, c
    assert [tuple(r) for r in out.orderBy("termination_id").collect()] == [
        (1, 4, -2, 366, 731, 3, 2, 0, 3, 1, 0), (2, 999, 999, 0, 0, 0, 4, 1, 0, 0, 0), (3, 999, 999, 3652058, 0, 0, 4, 1, 0, 1, 1)]
    assert dict(out.dtypes)["days_since_communication"] == "bigint" and dict(out.dtypes)["health_score"] == "int"
