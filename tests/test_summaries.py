"""Sums above a value, and daily summaries against the scored rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staywise.operators import metrics as M
from staywise.operators.ordering import sums_above
from staywise.operators.summaries import ScoreSummaries


def scored(spark, n=3000, seed=2):
    rng = random.Random(seed)
    rows = [(k, f"2001-08-{1 + k % 30:02d}", round(rng.random() ** 3, rng.choice((2, 5, 17))), int(rng.random() < 0.3)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, day string, p double, y int")


def plain_auc(rows):
    pos = sorted(p for _, _, p, y in rows if y)
    neg = [p for _, _, p, y in rows if not y]
    u = sum(len(pos) - np.searchsorted(pos, x, "right") + 0.5 * (np.searchsorted(pos, x, "right") - np.searchsorted(pos, x, "left")) for x in neg)
    return u / (len(pos) * len(neg))


def test_days_from_their_summaries(spark, tmp_path):
    rows, df = scored(spark)
    s = ScoreSummaries(spark, str(tmp_path / "s"))
    assert s.auc().first()[0] == 0.5 and s.counts().collect() == []
    for part in (range(1, 11), range(11, 31), range(5, 7)):  # two days again
        s.add(df.where(F.dayofmonth(F.to_date("day")).isin(list(part))))
    assert spark.read.parquet(str(tmp_path / "s")).select("day").distinct().count() == 30
    assert abs(s.auc().first()["auc_roc"] - plain_auc(rows)) < 1e-12
    some = [r for r in rows if "2001-08-04" <= r[1] <= "2001-08-17"]
    assert abs(s.auc("2001-08-04", "2001-08-17").first()["auc_roc"] - plain_auc(some)) < 1e-12
    assert sorted(map(tuple, s.pr_curve().collect())) == sorted(map(tuple, M.pr_curve(df).collect()))
    probs = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    got = {r["p"]: r["q"] for r in s.quantiles(probs).collect()}
    want = np.quantile([r[2] for r in rows], probs)
    assert np.allclose([got[p] for p in probs], want, rtol=1e-12)


@pytest.mark.parametrize("kind", ["unit", "crowded", "wide"])
def test_sums_above_any_doubles(spark, kind):
    rng = random.Random(1)
    make = {"unit": rng.random, "crowded": lambda: 0.5 + rng.randrange(400) * 1e-13, "wide": lambda: rng.choice((-1, 1)) * 10 ** rng.uniform(-20, 20)}[kind]
    values = list({(g, make()) for g in "ab" for _ in range(300)})
    df = spark.createDataFrame([(g, v, rng.randint(0, 5)) for g, v in values], "g string, v double, n int")
    rows = df.collect()
    for group in ([], ["g"]):
        if not group and len({v for _, v in values}) < len(values):
            continue
        out = sums_above(df, group, "v", {"above": "n"}, {"total": "above"}).collect()
        same = lambda a, b: not group or a["g"] == b["g"]
        assert len(out) == len(rows)
        for r in out[:200]:
            assert r["above"] == sum(x["n"] for x in rows if same(r, x) and x["v"] > r["v"])
            assert r["total"] == sum(x["n"] for x in rows if same(r, x))


def test_making_the_plan_runs_no_job(spark):
    _, df = scored(spark, 50)
    spark.sparkContext.setJobGroup("plan", "plan only")
    try:
        M.auc(df), M.pr_curve(df), M.auc(df.withColumn("g", F.lit(1)), by=["g"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
