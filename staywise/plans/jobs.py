"""End-to-end jobs.

``train_churn``: terminations -> features -> training matrix (materialised)
-> train, validation and test parts -> calibrated boosted trees -> threshold on
the validation part, metrics on the test part -> versioned model bundle with its
vocabularies + model-run row.

``score_daily``: active clients -> scoring matrix -> probability, score,
level -> previous confirmed level (earlier days only) from the table of each
client's last days, which is refreshed from what the store published -> two-strike confirmation -> serving factors -> upsert into the daily store ->
run-log row.  ``as_of`` is a parameter; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.operators import audit as AU
from staywise.operators import features as FT
from staywise.operators import history as H
from staywise.operators import metrics as M
from staywise.operators import model as MO
from staywise.operators import rules as R
from staywise.operators.dictionary import Dictionary
from staywise.session import materialize
from staywise.sources import adapters as A
from staywise.sources import ingest as I
from staywise.sources import reports as RP
from staywise.sources.latest import LatestTable
from staywise.sources.store import DailyStore, run_log

LABEL = "client_lost"


def train_churn(spark: SparkSession, sf_dir: str, model_root: str, version: str,
                params: dict | None = None, calibrated: bool = True) -> dict:
    """Fits, calibrates and saves a bundle.  Its categories keep the codes of the
    dictionary beside the models, whatever was seen since.  The threshold is
    chosen on a validation part, the metrics are those of the test part (T7);
    features that give the label away are warned of (T6); the rows before and
    after the notice-date filter are noted (T18)."""
    t = A.terminations(spark, sf_dir)
    data = FT.training_data(t)
    codes = Dictionary(spark, f"{model_root.rstrip('/')}/_dictionary")
    codes.extend(data, {c: v for c, v in FT.MATRIX_VOCABULARIES.items() if c in data.columns})
    tm = materialize(FT.training_matrix(data, codes.table()).withColumn(LABEL, F.col(LABEL).cast("int")))
    guard = MO.fit_guard(tm, LABEL)
    s = materialize(AU.three_way_split(tm, y=LABEL))
    train = s.filter(F.col("split") == "train").drop("split")
    model = MO.calibrate(train, FT.TRAINING_MATRIX_12, LABEL, 5, params) if calibrated else MO.fit_boosted(train, FT.TRAINING_MATRIX_12, LABEL, params)
    held = s.filter(F.col("split") != "train").withColumn(LABEL, F.col(LABEL).cast("double"))
    scored = materialize(MO.score(held, model, ["id", "split", LABEL], "p").select("id", "split", "p", F.col(LABEL).cast("int").alias("y")))
    best = M.best_threshold_grid(M.threshold_sweep(scored.filter("split = 'validation'"))).first()["threshold"]
    test = scored.filter("split = 'test'")
    metrics = M._one_row_join(M.metrics_from_confusion(M.confusion(test, best)), M.auc(test)).first().asDict()
    leaks = [r["feature"] for r in AU.leaks(tm, FT.TRAINING_MATRIX_12, LABEL).collect()]  # at most the features
    meta = {"version": version, "features": list(FT.TRAINING_MATRIX_12), "threshold": best, "calibrated": calibrated,
            "metrics": metrics, "train_rows": guard["rows"], "input_rows": t.count(),
            "warnings": [*guard["warnings"], *[f"{f} gives the label away" for f in leaks]],
            "params": {**MO.DEFAULT_PARAMS, **(params or {})}}
    MO.save(model, meta, model_root, version, {c: codes.vocabulary(c) for c in FT.MATRIX_VOCABULARIES})
    first = model.members[0][0] if calibrated else model
    imp = MO.feature_importances(spark, first, FT.TRAINING_MATRIX_12)
    RP.append_model_run(RP.model_run_row(spark, "churn_gbt", version, metrics, imp, meta["params"]),
                        f"{model_root.rstrip('/')}/_runs")
    return meta


def score_daily(spark: SparkSession, sf_dir: str, model_root: str, store_root: str, as_of: str,
                version: str = "latest") -> DataFrame:
    """Scores every active client on the day of ``as_of`` and returns the run row."""
    model, meta, version = MO.load(model_root, version)
    clients = I.scan_clients(A.clients(spark, sf_dir), active_only=True)
    sm = FT.scoring_matrix(clients, FT.training_data(A.terminations(spark, sf_dir)))
    scored = MO.score(sm, model, ["client_id", *FT.TRAINING_MATRIX_12])
    day = F.to_date(F.lit(as_of))
    new = (scored.withColumn("prediction_date", F.to_timestamp_ntz(F.lit(as_of)))
           .withColumn("prediction_day", day)
           .withColumn("id", F.xxhash64(F.col("client_id"), F.lit(as_of)))
           .withColumn("model_version", F.lit(version)))
    store = DailyStore(spark, store_root, "client_id")
    recent = LatestTable(store)
    recent.refresh()  # whatever an interrupted run or another writer has left
    new = recent.previous_level(new, as_of[:10])
    new = (new.withColumn("risk_level", H.confirm_step(F.col("risk_level"), F.col("previous_level")))
           .drop("previous_level", "previous_day"))
    new = R.sync_factors(new, 5)
    new = materialize(new)
    store.upsert(new, version=as_of[:10].replace("-", "") + "_" + version)
    recent.refresh()
    return run_log(new, "churn_gbt", version, as_of, as_of)
