"""Paths 1 and 2 end to end on the smallest fixture."""

from pyspark.sql import functions as F

from staywise.plans import jobs as J
from tests.conftest import SF_SMALL


def test_train_then_score_two_days(spark, tmp_path):
    models, store = str(tmp_path / "models"), str(tmp_path / "store")
    meta = J.train_churn(spark, SF_SMALL, models, "20010801_000000", {"maxIter": 3, "maxDepth": 2})
    assert 0.0 <= meta["metrics"]["auc_roc"] <= 1.0
    assert spark.read.parquet(f"{models}/_runs").count() == 1
    r1 = J.score_daily(spark, SF_SMALL, models, store, "2001-08-02 06:00:00").first()
    r2 = J.score_daily(spark, SF_SMALL, models, store, "2001-08-03 06:00:00").first()
    assert r1.total_predictions == r2.total_predictions > 0
    from staywise.sources.store import DailyStore
    cur = DailyStore(spark, store).current()
    per_day = {str(r.prediction_day): r["count"] for r in cur.groupBy("prediction_day").count().collect()}
    assert per_day == {"2001-08-02": r1.total_predictions, "2001-08-03": r2.total_predictions}
    # one row per client per day, and the second day never jumps low -> high
    assert cur.groupBy("client_id", "prediction_day").count().filter(F.col("count") > 1).count() == 0
