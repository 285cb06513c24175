"""Streaming jobs (L1-L4).  Each continues a batch operator and must give the
same rows as its batch twin on the same files.

L1 keeps, per entity, only the last confirmed level and its day in the state
store (``applyInPandasWithState``); a micro-batch sorts each entity's new
rows and folds them through the two-strike rule.  Rows not newer than the
state's day are late: they are emitted with ``late = true`` and routed to a
separate table by the sink, never folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from staywise.functions.dates import ntz_micros
from staywise.operators import features as FT
from staywise.operators import history as H
from staywise.sources.membership import FeatureTable

CONFIRM_OUT = ("client_id long, prediction_day date, risk_level string, confirmed_level string, late boolean")
CONFIRM_STATE = "last_day date, last_level string"


def _confirm_step(prev: str | None, level: str) -> str:
    if prev is None:
        return level
    if level == "critical" and prev not in ("critical", "high"):
        return "high"
    if level == "high" and prev == "low":
        return "medium"
    return level


def _confirm_group(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last_day, last_level = (state.get if state.exists else (None, None))
    # plain lists: a group has a few rows, and each pandas step on it costs more than all of them
    rows = sorted((x for pdf in pdfs for x in zip(pdf["prediction_day"].tolist(), pdf["risk_level"].tolist())), key=lambda x: (x[0] is None, x[0]))
    out = []
    for day, level in rows:
        if last_day is not None and day <= last_day:
            out.append((key[0], day, level, None, True))
            continue
        c = _confirm_step(last_level, level)
        out.append((key[0], day, level, c, False))
        last_day, last_level = day, c
    if last_day is not None:
        state.update((last_day, last_level))
    yield pd.DataFrame(out, columns=["client_id", "prediction_day", "risk_level", "confirmed_level", "late"])


def stream_confirm(daily_stream: DataFrame) -> DataFrame:
    """L1: streaming E4 over a stream of (client_id, prediction_day, risk_level)."""
    from staywise.session import ship_package
    ship_package(daily_stream.sparkSession)
    return (daily_stream.groupBy("client_id")
            .applyInPandasWithState(_confirm_group, CONFIRM_OUT, CONFIRM_STATE, "append",
                                    GroupStateTimeout.NoTimeout))


NO_MONTH = "none"


def stream_features(terms_stream: DataFrame, feature_path: str, checkpoint: str):
    """L2: J1 features for new termination rows, appended idempotently.

    The feature table is partitioned by notice month (``none`` where there is
    no notice date).  The filters of a micro-batch's months (a handful) say which
    of its ids may be there already; stored ids are read only for these, so a
    replayed batch writes nothing (C2 semantics: compute only what is missing)."""
    def write(batch: DataFrame, batch_id: int):
        month = F.coalesce(F.date_format(F.col("notice_date"), "yyyy-MM"), F.lit(NO_MONTH))
        FeatureTable(batch.sparkSession, feature_path).append(FT.form_features(batch, {"notice_month": month}))
    return (terms_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stored_ids(spark: SparkSession, feature_path: str, months: list[str]) -> DataFrame | None:
    """(notice_month, termination_id) of the stored rows of these months."""
    return FeatureTable(spark, feature_path).ids(months)


def stream_feedback_days(fb_stream: DataFrame, day_path: str, checkpoint: str, delay: str = "1 day"):
    """L3, the stream: feedback and true positives per day.  The state holds one
    row per day that is still open (the watermark closes days ``delay`` behind
    the latest feedback); each micro-batch rewrites the day folders it changed,
    so a replay leaves the same table."""
    ch = F.col("actually_churned")
    # the watermark needs a zoned timestamp: use the instant whose UTC clock
    # equals the wall clock, so days align to wall-clock days in any zone
    clock = fb_stream.withColumn("feedback_date", F.timestamp_micros(ntz_micros("feedback_date")))
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    days = (clock.withWatermark("feedback_date", delay).groupBy(F.window("feedback_date", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("total_feedback"), F.sum(F.when(ch, 1).otherwise(0)).alias("true_positives"))
            .select(F.to_date(F.timestamp_add("MICROSECOND", F.unix_micros("w.start"), epoch)).alias("day"),
                    "total_feedback", "true_positives"))

    def sink(batch: DataFrame, batch_id: int):
        (batch.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(day_path))
    return (days.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .outputMode("update").trigger(availableNow=True).start())


def feedback_windows(days: DataFrame, width: int = 90) -> DataFrame:
    """L3, the report: precision over windows of ``width`` days, one a day, from
    the day table (so the expansion is per day of history, not per feedback)."""
    starts = F.explode(F.sequence(F.date_sub("day", width - 1), F.col("day")))
    return (days.select(starts.alias("s"), "total_feedback", "true_positives").groupBy("s")
            .agg(F.sum("total_feedback").alias("total_feedback"), F.sum("true_positives").alias("true_positives"))
            .select(F.col("s").cast("timestamp_ntz").alias("window_start"),
                    F.date_add("s", width).cast("timestamp_ntz").alias("window_end"),
                    "total_feedback", "true_positives",
                    (F.col("true_positives") / F.col("total_feedback")).alias("actual_precision")))


def stream_upsert(pred_stream: DataFrame, store_root: str, checkpoint: str, key: str = "client_id"):
    """L4: each micro-batch is upserted into the daily store (A15).  The store
    numbers its writes itself, so a new checkpoint (batch ids from 0) goes on
    after what is stored."""
    from staywise.sources.store import DailyStore

    def write(batch: DataFrame, batch_id: int):
        DailyStore(batch.sparkSession, store_root, key).upsert(batch, version=f"{batch_id:08d}")
    return (pred_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def files_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """A file source read in file order, ``max_files`` per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_confirm(spark: SparkSession, src: str, out: str, checkpoint: str, max_files: int = 1,
                state_partitions: int | None = None):
    """Drive L1 to completion over the files in ``src`` (availableNow).
    Confirmed rows go to ``<out>/confirmed``, late rows to ``<out>/late``;
    a replayed micro-batch overwrites its own ``batch=<id>`` folders, so
    a restart after a failure does not duplicate rows.  Returns both tables
    united with the ``late`` flag.  ``state_partitions`` fixes the number of
    state-store partitions of a new query (sized to the entity count on a
    cluster); the session setting is restored once the query has started."""
    schema = "client_id long, prediction_day date, risk_level string"

    def sink(batch: DataFrame, batch_id: int):
        batch.persist()
        batch.filter(~F.col("late")).write.mode("overwrite").parquet(f"{out}/confirmed/batch={batch_id}")
        batch.filter(F.col("late")).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        batch.unpersist()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        q = (stream_confirm(files_stream(spark, src, schema, max_files)).writeStream.foreachBatch(sink)
             .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    q.awaitTermination()
    return (spark.read.parquet(f"{out}/confirmed").unionByName(spark.read.parquet(f"{out}/late"))
            .drop("batch"))


def daily_for_stream(preds: DataFrame) -> DataFrame:
    d = H.one_per_day(H.score_levels(preds), "client_id")
    return d.select("client_id", "prediction_day", "risk_level")
