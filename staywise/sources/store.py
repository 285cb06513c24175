"""Daily prediction store and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.functions.dates import ntz_micros
from staywise.operators.history import upsert_daily
from staywise.sources.tables import read_if_exists


class DailyStore:
    """One row per entity per day.

    No table format with MERGE is installed, so every write goes to a folder
    of its own: ``<root>/w=<sequence>-<id>/<day>=D/`` for each day in the batch,
    the stored rows of that day merged in (the later row wins).  Only when the
    data is complete does the manifest ``<root>/_manifest`` name it, with a
    sequence number greater than all before; readers take each day's greatest.
    No published file is ever overwritten, a day that is half written is never
    seen, and a batch that is written again (a replay, or the same version name)
    merges into what is there.  The version is a label and decides nothing.

    One writer at a time per store.  Rows without a day cannot be placed; they
    go to ``<root>/_quarantine``.  ``day_col`` is taken from the rows, or else
    is the date of ``ts_col``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "client_id",
                 ts_col: str = "prediction_date", tiebreak: str = "id", day_col: str = "prediction_day"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.ts, self.tb, self.day = ts_col, tiebreak, day_col
        self.schema = f"{day_col} date, sequence long, version string, folder string"

    def manifest(self) -> DataFrame:
        """(day, sequence, version, folder) of every write; empty before the first."""
        m = read_if_exists(self.spark, f"{self.root}/_manifest", self.schema)
        return self.spark.createDataFrame([], self.schema) if m is None else m

    def current(self, days: list | None = None) -> DataFrame | None:
        m = self.manifest()
        if days is not None:
            m = m.filter(F.col(self.day).isin(days))
        # one row per stored day: bounded by the days of history
        cur = m.groupBy(self.day).agg(F.max_by("folder", "sequence").alias("folder")).collect()
        out = None
        by_folder: dict[str, list[str]] = {}
        for r in cur:
            by_folder.setdefault(r["folder"], []).append(f"{self.root}/{r['folder']}/{self.day}={r[self.day]}")
        for folder, paths in by_folder.items():
            part = self.spark.read.option("basePath", f"{self.root}/{folder}").parquet(*paths)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def upsert(self, new: DataFrame, version: str) -> list:
        new = new if self.day in new.columns else new.withColumn(self.day, F.to_date(F.col(self.ts)))
        # the days of one batch (a handful) decide which stored days are touched
        found = [r[0] for r in new.select(self.day).distinct().collect()]
        days = [d for d in found if d is not None]
        last = self.manifest().agg(F.max("sequence")).first()[0]
        sequence = 0 if last is None else last + 1
        folder = f"w={sequence:010d}-{uuid.uuid4().hex[:12]}"
        if None in found:
            new.filter(F.col(self.day).isNull()).write.parquet(f"{self.root}/_quarantine/{folder}")
            new = new.filter(F.col(self.day).isNotNull())
        if not days:
            return days
        old = self.current(days)
        merged = upsert_daily(new, new.limit(0) if old is None else old, self.key, self.ts, self.tb, self.day)
        merged.write.partitionBy(self.day).parquet(f"{self.root}/{folder}")
        rows = [(d, sequence, version, folder) for d in days]
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")
        return days


def feedback_store(spark: SparkSession, root: str) -> DailyStore:
    """One feedback row per client and prediction day, the latest feedback wins."""
    return DailyStore(spark, root, "client_id", ts_col="feedback_date", tiebreak="actually_churned", day_col="prediction_date")


def member_store(spark: SparkSession, root: str) -> DailyStore:
    """A15 for members: one attrition prediction per member and day."""
    return DailyStore(spark, root, "team_member_id")


def export_all(datasets: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, int]:
    """A10: each non-empty dataset written as csv / json / parquet.  A11: a
    metadata document (dataset, rows, columns; empty sets included, they have no
    files) is written beside them as ``_metadata`` and the row counts of the
    written ones are returned."""
    meta, described = {}, []
    for name, df in datasets.items():
        n = df.count()
        described.append((name, n, df.columns))
        if not n:
            continue
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(f"{path}/{name}")
        elif fmt == "json":
            w.json(f"{path}/{name}")
        else:
            w.parquet(f"{path}/{name}")
        meta[name] = n
    if described:
        spark = next(iter(datasets.values())).sparkSession
        (spark.createDataFrame(described, "dataset string, rows long, columns array<string>")
         .coalesce(1).write.mode("overwrite").json(f"{path}/_metadata"))
    return meta


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The newest file matching a glob by modification time."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    r = files.agg(F.max_by("path", "modificationTime").alias("p")).first()
    return r["p"] if r else None


def write_predictions_csv(preds: DataFrame, path: str, order_col: str = "churn_probability") -> None:
    """Sorted results as CSV."""
    preds.orderBy(F.col(order_col).desc()).write.mode("overwrite").option("header", True).csv(path)


def export_predictions(preds: DataFrame, folder: str, as_of: str, order_col: str = "churn_probability") -> str:
    """``predictions_<stamp>.csv`` of one instant below ``folder``, sorted;
    an export of the same instant replaces its own.  Returns the path; the newest
    of all is ``latest_predictions``."""
    stamp = "".join(c if c.isdigit() else "_" if c in " T" else "" for c in as_of[:19])
    path = f"{folder.rstrip('/')}/predictions_{stamp}.csv"
    write_predictions_csv(preds, path, order_col)
    return path


def latest_predictions(spark: SparkSession, folder: str) -> DataFrame | None:
    """The export of the latest instant, as text; none if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path")
    name = F.regexp_extract("path", r"/predictions_([0-9]{8}(?:_[0-9]{1,6})?)\.csv/", 1)
    r = files.where(name != "").agg(F.max(name)).first()[0]
    return None if r is None else spark.read.option("header", True).csv(f"{folder.rstrip('/')}/predictions_{r}.csv")


def run_log(preds: DataFrame, model_name: str, model_version: str, start: str, end: str,
            error: str | None = None) -> DataFrame:
    """One run row from one aggregation of the scored batch."""
    lv = F.col("risk_level")
    ok = error is None
    return preds.agg(F.count(F.lit(1)).alias("total_predictions"),
                     F.count_if(lv.isin("high", "critical")).alias("high_risk_count"),
                     F.count_if(lv == "medium").alias("medium_risk_count"),
                     F.count_if(lv == "low").alias("low_risk_count")).select(
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"), "*",
        (F.col("total_predictions") if ok else F.lit(0)).alias("successful_predictions"),
        F.lit(0 if ok else 1).alias("failed_predictions"),
        F.to_timestamp_ntz(F.lit(start)).alias("start_time"), F.to_timestamp_ntz(F.lit(end)).alias("end_time"),
        F.floor((ntz_micros(F.to_timestamp_ntz(F.lit(end))) - ntz_micros(F.to_timestamp_ntz(F.lit(start))))
                / 1_000_000).alias("duration_seconds"),
        F.lit("completed" if ok else "failed").alias("status"), F.lit(error).cast("string").alias("error_message"))


def append_predictions(preds: DataFrame, path: str, quarantine_path: str | None = None,
                       **validate_kw) -> DataFrame:
    """Defaults for missing document fields, validity split (A18); good
    rows are appended to the prediction table, bad rows to a quarantine table.
    Returns one row of counts: total_rows, valid_rows, quarantined_rows."""
    from staywise.operators.history import validate, validation_counts
    if "features" not in preds.columns:
        preds = preds.withColumn("features", F.create_map().cast("map<string,double>"))
    if "top_risk_factors" not in preds.columns:
        preds = preds.withColumn("top_risk_factors", F.array().cast("array<string>"))
    good, bad = validate(preds, **validate_kw)
    good.write.mode("append").parquet(path)
    if quarantine_path:
        bad.write.mode("append").parquet(quarantine_path)
    return validation_counts(preds, **validate_kw)
