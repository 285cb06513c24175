"""Registered queries over file round trips and JSON documents (A1, A2, A10,
A13, H24-H26).  Files are written under the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from staywise.functions.dates import version_stamp
from staywise.functions.values import feature_map, map_get
from staywise.operators import features as FT
from staywise.plans.oracle_views import with_views
from staywise.plans.q_features import (AS_OF as ACC_AS_OF, BOOL, CLIENT_FEATURES_SQL, FORM_FEATURES_SQL,
                                       SCORING_SELECT, TRAINING_DATA_SQL, _vocab_sql)
from staywise.plans.registry import query
from staywise.session import checkpoint_dir
from staywise.sources import adapters as A
from staywise.sources import ingest as I
from staywise.sources.store import export_all

# adapter column -> form header (one of the two spellings for the timeframe,
# the other spelling is written too so the import has to merge them)
FORM_EXPORT = {
    "client_name": "Client Name",
    "notice_date": "Date of Receiving Termination/Replacement/Resignation Notice",
    "termination_reason": "Reason for Termination",
    "check_in_cadence": "Cadence of Check Ins With The Client",
    "will_have_replacement": "Will There Be A Replacement",
    "health_text": "Specify the Client Health In The Last Month",
    "pip_implemented": "Was a Performance Improvement Plan Implemented?",
    "relief_offered": "Business Issue Termination - Was the relief package/discounts offered?",
    "tm_start_date": "Team Member  Start Date ",
    "geo_location": "Geo - Location",
    "client_lost": "Have we lost the Client?",
}


@query("form_import_roundtrip", with_views(f"""
SELECT client_name, CAST(notice_date AS VARCHAR) AS termination_notice_date, termination_reason,
       check_in_cadence, CAST({BOOL('will_have_replacement')} AS BIGINT) AS will_have_replacement,
       health_text AS client_health_last_month, CAST({BOOL('pip_implemented')} AS BIGINT) AS pip_implemented,
       CAST({BOOL('relief_offered')} AS BIGINT) AS relief_package_offered,
       CAST(tm_start_date AS VARCHAR) AS team_member_start_date, geo_location,
       CAST({BOOL('client_lost')} AS BIGINT) AS client_lost, replacement_timeframe
FROM terminations WHERE client_name IS NOT NULL AND trim(client_name) <> ''""", "terminations"))
def form_import_roundtrip(spark, sf):
    """A10/A13 -> A1/A2: every termination row exported as the form CSV (both
    spellings of the timeframe header, each filled on half of the rows, and a
    header with a doubled blank), then imported through the header map."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/staywise-form-{uuid.uuid4().hex[:12]}"
    t = A.terminations(spark, sf)
    odd = F.col("id") % 2 == 1
    out = t.select(*[F.col(c).cast("string").alias(h) for c, h in FORM_EXPORT.items()],
                   F.when(~odd, F.col("replacement_timeframe")).alias("Timeframe for Replacement"),
                   F.when(odd, F.col("replacement_timeframe")).alias("Time Frame for Replacement"),
                   )
    export_all({"form": out}, base, "csv")
    imported = I.import_terminations(spark, f"{base}/form")
    return imported.select(
        "client_name", "termination_notice_date", "termination_reason", "check_in_cadence",
        "will_have_replacement", "client_health_last_month", "pip_implemented", "relief_package_offered",
        "team_member_start_date", "geo_location", "client_lost", "replacement_timeframe")


_FEATS = ", ".join(FT.CLIENT_FEATURES)
_CASTS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FT.CLIENT_FEATURES)


@query("feature_documents", with_views(f"""
SELECT u.id AS client_id, u.feature, u.value, CAST(c.tenure_months AS DOUBLE) AS tenure_lookup
FROM (SELECT * FROM (SELECT id, {_CASTS} FROM cf) UNPIVOT (value FOR feature IN ({_FEATS}))) u
JOIN cf c ON c.id = u.id""", "clients", extra={"vi": _vocab_sql("clients", "industry_type", "OTHER"),
                                                "vl": _vocab_sql("clients", "client_location", "Unknown"),
                                                "cf": CLIENT_FEATURES_SQL}))
def feature_documents(spark, sf):
    """Client features as a map, encoded to JSON (as stored with a
    prediction), decoded back, read with a default and exploded."""
    f = FT.client_features(A.clients(spark, sf), ACC_AS_OF)
    doc = f.select(F.col("id").alias("client_id"), F.to_json(feature_map(FT.CLIENT_FEATURES)).alias("features"))
    back = doc.select("client_id", F.from_json("features", "map<string,double>").alias("m"))
    return back.select("client_id", F.explode("m").alias("feature", "value"),
                       map_get("m", "tenure_months", 12.0).alias("tenure_lookup"))


@query("version_stamps", with_views("""
SELECT DISTINCT strftime(prediction_date, '%Y%m%d_%H%M%S') AS version FROM predictions""", "predictions"))
def version_stamps(spark, sf):
    """Version stamps of every prediction instant."""
    return A.predictions(spark, sf).select(version_stamp("prediction_date").alias("version")).distinct()


@query("sync_predictions", with_views("""
SELECT l.client_id, l.churn_probability,
       CASE WHEN l.churn_probability >= 0.75 THEN 'critical' WHEN l.churn_probability >= 0.5 THEN 'high'
            WHEN l.churn_probability >= 0.25 THEN 'medium' ELSE 'low' END AS risk_level,
       CAST(trunc(l.churn_probability * 100) AS BIGINT) AS risk_score,
       s.current_seat_count AS seat_count, s.health_score AS health_score,
       CAST(least(5, CAST(s.days_since_communication > 30 AS INT) + CAST(s.days_since_checkin > 14 AS INT)
                     + CAST(s.health_score <= 2 AS INT) + CAST(s.no_replacement = 1 AS INT)
                     + CAST(s.had_pip = 1 AS INT)) AS BIGINT) AS factor_count
FROM latest_cp l JOIN sm s ON s.client_id = l.client_id""", "latest_cp", "terminations", "clients", extra={
    "ff": FORM_FEATURES_SQL, "td": TRAINING_DATA_SQL, "sm": SCORING_SELECT}))
def sync_predictions(spark, sf):
    """A17 (dry run): each active client's latest probability with its
    scoring features, shaped as synced records; the check reads the
    document back (H25) and counts the factors."""
    from staywise.operators import rules as R
    from staywise.plans.q_history import latest_cp
    lat = latest_cp(spark, sf).select("client_id", "churn_probability")
    active = I.scan_clients(A.clients(spark, sf), active_only=True)
    sm = FT.scoring_matrix(active, FT.training_data(A.terminations(spark, sf)))
    recs = R.sync_records(lat.join(sm, "client_id", "inner"), "v1", A.AS_OF_PREDICTIONS)
    return recs.select("client_id", "churn_probability", "risk_level", F.col("risk_score"),
                       map_get("features", "seat_count", 1.0).alias("seat_count"),
                       map_get("features", "health_score", 0.0).alias("health_score"),
                       F.size("top_risk_factors").alias("factor_count"))


@query("append_predictions", with_views("""
SELECT id, client_id, prediction_date, churn_probability, model_version, risk_level, risk_score,
       CAST(0 AS BIGINT) AS n_features, CAST(0 AS BIGINT) AS n_factors
FROM spreds WHERE churn_probability BETWEEN 0 AND 1 AND risk_score BETWEEN 0 AND 100
  AND risk_level IN ('low', 'medium', 'high', 'critical')""", "spreds"))
def append_predictions(spark, sf):
    """Every scored prediction validated and appended (documents default
    to empty), read back from the table."""
    from staywise.operators.history import score_levels
    from staywise.sources.store import append_predictions as append
    base = f"{checkpoint_dir(spark).rstrip('/')}/staywise-append-{uuid.uuid4().hex[:12]}"
    append(score_levels(A.predictions(spark, sf)), f"{base}/predictions", f"{base}/quarantine")
    back = spark.read.parquet(f"{base}/predictions")
    return back.select("id", "client_id", "prediction_date", "churn_probability", "model_version", "risk_level",
                       "risk_score", F.size("features").alias("n_features"),
                       F.size("top_risk_factors").alias("n_factors"))


@query("prediction_run_log", with_views("""
SELECT 'churn_gbt' AS model_name, 'v1' AS model_version, count(*) AS total_predictions,
       count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS high_risk_count,
       count(*) FILTER (WHERE risk_level = 'medium') AS medium_risk_count,
       count(*) FILTER (WHERE risk_level = 'low') AS low_risk_count,
       count(*) AS successful_predictions, CAST(0 AS BIGINT) AS failed_predictions,
       TIMESTAMP '2024-01-31 00:00:00' AS start_time, TIMESTAMP '2024-01-31 00:02:05' AS end_time,
       CAST(125 AS BIGINT) AS duration_seconds, 'completed' AS status, CAST(NULL AS VARCHAR) AS error_message
FROM spreds""", "spreds"))
def prediction_run_log(spark, sf):
    """The run row of scoring every prediction (explicit start and end)."""
    from staywise.operators.history import score_levels
    from staywise.sources.store import run_log
    return run_log(score_levels(A.predictions(spark, sf)), "churn_gbt", "v1",
                   "2024-01-31 00:00:00", "2024-01-31 00:02:05")


def _store_folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/staywise-{name}-{uuid.uuid4().hex[:12]}"


@query("upsert_twice_same_day", with_views("""
SELECT client_id, prediction_day, id, churn_probability FROM daily""", "daily"))
def upsert_twice_same_day(spark, sf):
    """Two writes into the same days, named v9 and v10; the later one counts."""
    from staywise.sources.store import DailyStore
    store = DailyStore(spark, _store_folder(spark, "twice"))
    p = A.predictions(spark, sf)
    store.upsert(p.filter(F.col("id") % 2 == 0), "20240130_v9")
    store.upsert(p.filter(F.col("id") % 2 != 0), "20240130_v10")
    return store.current().select("client_id", "prediction_day", "id", "churn_probability")


@query("upsert_with_features", with_views("""
SELECT client_id, prediction_day, id, churn_probability AS stored, CAST(id AS DOUBLE) AS id_feature FROM daily""", "daily"))
def upsert_with_features(spark, sf):
    """A15 on rows that carry their features as a map."""
    from staywise.sources.store import DailyStore
    store = DailyStore(spark, _store_folder(spark, "maps"))
    p = A.predictions(spark, sf).withColumn("features", F.create_map(
        F.lit("p"), F.col("churn_probability"), F.lit("id"), F.col("id").cast("double")))
    store.upsert(p, "v1")
    store.upsert(p.filter(F.col("id") % 3 == 0), "v2")
    return store.current().select("client_id", "prediction_day", "id", F.col("features")["p"].alias("stored"),
                                  F.col("features")["id"].alias("id_feature"))


@query("feedback_upsert", with_views("""
SELECT client_id, prediction_date, feedback_date, actually_churned FROM fb_dedup""", "fb_dedup"))
def feedback_upsert(spark, sf):
    """Feedback written in two batches, one row per client and prediction day."""
    from staywise.sources.store import feedback_store
    store = feedback_store(spark, _store_folder(spark, "feedback"))
    fb = A.feedback(spark, sf)
    store.upsert(fb.filter("actually_churned"), "1")
    store.upsert(fb.filter("not actually_churned"), "2")
    return store.current().select("client_id", "prediction_date", "feedback_date", "actually_churned")


@query("active_clients", """
SELECT c_custkey AS id, o.is_active AS is_active FROM customer c JOIN (
    SELECT o_custkey, max(o_orderdate) >= TIMESTAMP '2000-08-01 00:00:00' AS recent,
           CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE max(o_orderdate) >= TIMESTAMP '2000-08-01 00:00:00' END AS is_active
    FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey WHERE o.recent""")
def active_clients(spark, sf):
    """Clients flagged active, and unflagged ones whose status says so."""
    from staywise.operators.history import active
    return active(A.clients(spark, sf)).select("id", "is_active")


@query("validate_and_quarantine", with_views("""
SELECT id, NOT (coalesce(p BETWEEN 0 AND 1, false)) AS bad_probability, NOT coalesce(s BETWEEN 0 AND 100, false) AS bad_score
FROM (SELECT id, churn_probability * 4 - 1 AS p, CAST(trunc((churn_probability * 4 - 1) * 100) AS BIGINT) AS s FROM predictions)
WHERE NOT (coalesce(p BETWEEN 0 AND 1, false) AND coalesce(s BETWEEN 0 AND 100, false))""", "predictions"))
def validate_and_quarantine(spark, sf):
    """A18 on probabilities stretched past their range: the rows that fail, and why."""
    from staywise.operators.history import score_levels, validate
    p = A.predictions(spark, sf).withColumn("churn_probability", F.col("churn_probability") * 4 - 1)
    bad = validate(score_levels(p))[1]
    return bad.select("id", F.array_contains("reasons", "probability_out_of_range").alias("bad_probability"),
                      F.array_contains("reasons", "score_out_of_range").alias("bad_score"))


@query("orphan_predictions", with_views("""
SELECT p.id, p.client_id FROM predictions p WHERE p.client_id % 5 = 0""", "predictions"))
def orphan_predictions(spark, sf):
    """C8 against a client table that lacks every fifth client."""
    from staywise.operators.history import orphans
    some = A.clients(spark, sf).filter(F.col("id") % 5 != 0)
    known = A.predictions(spark, sf).join(A.clients(spark, sf).select(F.col("id").alias("client_id")), "client_id", "left_semi")
    return orphans(known, some, "client_id").select("id", "client_id")
