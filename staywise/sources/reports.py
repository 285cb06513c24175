"""Run and report writers (A19, A22, A23): small documents built from
DataFrames that Spark computed, written as JSON/Parquet next to the model."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def model_run_row(spark: SparkSession, name: str, version: str, metrics: Mapping[str, float],
                  importance: DataFrame, hyperparameters: Mapping, notes: str = "") -> DataFrame:
    """One ``model_runs`` row - five metrics, importance map and
    hyperparameter map (importance rows are one per feature)."""
    imp = {r["feature"]: float(r["importance"]) for r in importance.collect()}
    row = (name, version, *(float(metrics.get(k, 0.0)) for k in ("accuracy", "precision", "recall", "f1",
                                                                 "auc_roc")),
           imp, {k: str(v) for k, v in hyperparameters.items()}, notes)
    return spark.createDataFrame([row], "model_name string, model_version string, accuracy double, "
                                        "precision double, recall double, f1 double, auc_roc double, "
                                        "feature_importance map<string,double>, "
                                        "hyperparameters map<string,string>, notes string")


def append_model_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").parquet(path)


def write_explanations(per_row: DataFrame, global_imp: DataFrame, levels: DataFrame, path: str,
                       model_info: Mapping) -> None:
    """Per-entity reasons, global importance and level summary as three
    tables plus a JSON export of each; model info as a one-line JSON."""
    per_row.write.mode("overwrite").parquet(f"{path}/per_entity")
    global_imp.write.mode("overwrite").parquet(f"{path}/global_importance")
    levels.write.mode("overwrite").parquet(f"{path}/summary")
    per_row.select(F.to_json(F.struct(*per_row.columns)).alias("value")).write.mode("overwrite").text(
        f"{path}/per_entity_json")
    spark = per_row.sparkSession
    spark.createDataFrame([(json.dumps(dict(model_info), default=str),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/model_info")
