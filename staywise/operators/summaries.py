"""Mergeable score summaries (D13, D14, D16): exact counts of positives and
negatives by score, stored per day.

A day's counts are one aggregation of that day's scores; the AUC, the curve and
the best threshold of any set of days come from the sum of their counts, without
the scored rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.operators import metrics as M
from staywise.sources.tables import read_if_exists


class ScoreSummaries:
    """``root``: (day, score, pos, neg), partitioned by day.  A day that is
    summarised again replaces its folder, so a replay changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, scored: DataFrame, day: str = "day", y: str = "y", p: str = "p") -> None:
        """Summarises whole days of scored rows; rows without day or score are not counted."""
        counts = M.score_counts(scored.where(F.col(day).isNotNull() & F.col(p).isNotNull()), y, p, by=[F.to_date(day).alias("day")])
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.root)

    def counts(self, first: dt.date | str | None = None, last: dt.date | str | None = None) -> DataFrame:
        """(score, pos, neg) over the days from ``first`` to ``last`` (both included; none: open)."""
        rows = read_if_exists(self.spark, self.root)
        if rows is None:
            return self.spark.createDataFrame([], "score double, pos long, neg long")
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(str(first)).cast("date"))
        if last is not None:
            rows = rows.where(F.col("day") <= F.lit(str(last)).cast("date"))
        return rows.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    def auc(self, first=None, last=None) -> DataFrame:
        """D13 over days: one row, as ``metrics.auc`` gives it from the scored rows."""
        return M.auc_of(self.counts(first, last))

    def pr_curve(self, first=None, last=None) -> DataFrame:
        """D14 over days."""
        return M.pr_curve_of(self.counts(first, last))

    def quantiles(self, probs: Sequence[float], first=None, last=None) -> DataFrame:
        """D16 over days: (p, q), exact with linear interpolation.  The rows of
        each score are ranked by the counts; the target ranks are found in them."""
        c = self.counts(first, last).withColumn("n", F.col("pos") + F.col("neg"))
        ranked = M.sums_above(c, [], "score", {"above": "n"}, {"total": "above"})
        return M.quantiles_of(ranked.withColumn("start", F.col("total") - F.col("above") - F.col("n")), probs)
