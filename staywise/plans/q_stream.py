"""Registered streaming jobs: each runs to completion (``availableNow``) over
files derived from the given tables and returns what its sink holds; the
oracle is the SQL of its batch twin (stream = batch)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from staywise.operators import history as H
from staywise.plans.oracle_views import with_views
import staywise.plans.q_history  # noqa: F401  (registers the batch twins first)
from staywise.plans.q_features import FORM_FEATURES_SQL
from staywise.plans.registry import ORACLE, query
from staywise.session import checkpoint_dir
from staywise.sources import adapters as A
from staywise.sources.store import DailyStore
from staywise.streaming import jobs as J


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/staywise-{name}-{uuid.uuid4().hex[:12]}"


def _day_files(df, path: str, day_col: str = "prediction_day"):
    """Land the rows in one write, partitioned by day, and date the files in day
    order: the file source replays files by modification time, so the stream
    sees the days in event-time order.  (A live source lands them so by itself;
    only folder names and file dates pass the driver, one day at a time.)"""
    spark = df.sparkSession
    (df.withColumn("day_", F.col(day_col)).repartition(day_col).write.mode("overwrite")
     .partitionBy("day_").parquet(path))
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = sorted((f.getPath().getName(), f.getPath()) for f in fs.listStatus(root) if f.isDirectory())
    start = 1_000_000_000_000
    for k, (_, folder) in enumerate(folders):
        for f in fs.listStatus(folder):
            fs.setTimes(f.getPath(), start + 1000 * k, -1)


@query("stream_confirm", ORACLE["confirm_levels"].replace(
    "SELECT client_id, prediction_day, churn_probability, risk_level, confirmed_level FROM fold",
    "SELECT client_id, prediction_day, risk_level, confirmed_level FROM fold"))
def stream_confirm(spark, sf):
    """L1: streaming two-strike confirmation over daily prediction files."""
    base = _scratch(spark, "confirm")
    daily = J.daily_for_stream(A.predictions(spark, sf))
    src = f"{base}/src"
    _day_files(daily, src)
    out = J.run_confirm(spark, f"{src}/*", f"{base}/out", f"{base}/ckpt", max_files=3,
                        state_partitions=spark.sparkContext.defaultParallelism)
    return out.filter(~F.col("late")).select("client_id", "prediction_day", "risk_level", "confirmed_level")


@query("stream_upsert", with_views("""
SELECT client_id, prediction_day, id, churn_probability FROM daily""", "daily"))
def stream_upsert(spark, sf):
    """L4: daily upsert driven by a prediction stream (several files per day)."""
    base = _scratch(spark, "upsert")
    p = H.with_day(A.predictions(spark, sf))
    p.repartition(4).write.mode("overwrite").parquet(f"{base}/src")
    stream = spark.readStream.schema(p.drop("prediction_day").schema).option("maxFilesPerTrigger", 2) \
        .parquet(f"{base}/src")
    J.stream_upsert(stream, f"{base}/store", f"{base}/ckpt").awaitTermination()
    cur = DailyStore(spark, f"{base}/store").current()
    return cur.select("client_id", "prediction_day", "id", "churn_probability")


@query("stream_features", with_views(FORM_FEATURES_SQL, "terminations"))
def stream_features(spark, sf):
    """L2: incremental J1 features from a termination stream, idempotent."""
    base = _scratch(spark, "features")
    t = A.terminations(spark, sf)
    t.repartition(4).write.mode("overwrite").parquet(f"{base}/src")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/src")
    J.stream_features(stream, f"{base}/features", f"{base}/ckpt").awaitTermination()
    return spark.read.parquet(f"{base}/features").drop("notice_month")


@query("stream_feedback", with_views("""
SELECT window_start, window_start + INTERVAL 90 DAY AS window_end, count(*) AS total_feedback,
       CAST(sum(CASE WHEN actually_churned THEN 1 ELSE 0 END) AS BIGINT) AS true_positives,
       sum(CASE WHEN actually_churned THEN 1 ELSE 0 END) / count(*) AS actual_precision
FROM (SELECT f.*, date_trunc('day', f.feedback_date) - to_days(CAST(r.i AS INTEGER)) AS window_start
      FROM feedback f CROSS JOIN range(0, 90) r(i)) x
GROUP BY window_start""", "feedback"))
def stream_feedback(spark, sf):
    """L3: 90-day sliding feedback precision (1-day slide) over a feedback stream."""
    base = _scratch(spark, "feedback")
    fb = A.feedback(spark, sf)
    _day_files(fb, f"{base}/src", "prediction_date")
    stream = spark.readStream.schema(fb.schema).option("maxFilesPerTrigger", 8).parquet(f"{base}/src/*")
    J.stream_feedback_days(stream, f"{base}/days", f"{base}/ckpt").awaitTermination()
    return J.feedback_windows(spark.read.parquet(f"{base}/days"))


@query("stream_confirm_any_order", ORACLE["stream_confirm"])
def stream_confirm_any_order(spark, sf):
    """L1 with corrections: the same daily predictions landed in an order of days
    that is not theirs; the last emitted levels are those of the batch rule."""
    from staywise.streaming import corrections as C
    base = _scratch(spark, "corrected")
    daily = J.daily_for_stream(A.predictions(spark, sf))
    day = F.datediff("prediction_day", F.lit("2024-01-01").cast("date"))
    _day_files(daily.withColumn("order_", F.format_string("%05d", F.pmod(day * 7, F.lit(31)))), f"{base}/src", "order_")
    out = C.run_confirm(spark, f"{base}/src/*", f"{base}/out", f"{base}/ckpt", max_files=6, horizon=60,
                        state_partitions=spark.sparkContext.defaultParallelism)
    return out.select("client_id", "prediction_day", "risk_level", "confirmed_level")
