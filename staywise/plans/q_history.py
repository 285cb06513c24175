"""Registered queries over the prediction history (read side, path 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from staywise.operators import history as H
from staywise.operators import summary as S
from staywise.plans.oracle_views import level_sql, with_recursive_views, with_views
from staywise.plans.registry import query
from staywise.sources import adapters as A

AS_OF = A.AS_OF_PREDICTIONS
BATCH_DAY = "2024-01-30"


def scored_predictions(spark, sf):
    return H.score_levels(A.predictions(spark, sf))


def latest_cp(spark, sf):
    return H.latest_client_predictions(scored_predictions(spark, sf), A.clients(spark, sf))


def daily(spark, sf):
    return H.one_per_day(scored_predictions(spark, sf), "client_id")


@query("client_risk_summary", with_views("""
SELECT count(*) AS total_clients,
       count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS high_risk_count,
       count(*) FILTER (WHERE risk_level = 'medium') AS medium_risk_count,
       count(*) FILTER (WHERE risk_level = 'low') AS low_risk_count,
       round(avg(churn_probability), 6) AS avg_probability,
       count(*) FILTER (WHERE churn_probability > 0.5) AS clients_needing_attention
FROM latest_cp""", "latest_cp"))
def client_risk_summary(spark, sf):
    """D5 over C3/E1: how many customers need attention today."""
    return S.risk_summary(latest_cp(spark, sf))


@query("latest_client_predictions", with_views("SELECT * FROM latest_cp", "latest_cp"))
def latest_client_predictions(spark, sf):
    return latest_cp(spark, sf)


@query("latest_with_ties", with_views("""
SELECT p.* FROM predictions p
WHERE p.client_id IS NOT NULL
  AND p.prediction_date = (SELECT max(p2.prediction_date) FROM predictions p2 WHERE p2.client_id = p.client_id)""",
                                      "predictions"))
def latest_with_ties(spark, sf):
    return H.latest_with_ties(A.predictions(spark, sf), "client_id")


@query("one_per_day_upsert", with_views("SELECT * FROM daily", "daily"))
def one_per_day_upsert(spark, sf):
    """One prediction per client per day, the later row wins."""
    return daily(spark, sf)


@query("confirm_levels", with_recursive_views("""
SELECT client_id, prediction_day, churn_probability, risk_level, confirmed_level FROM fold""", "daily", extra={
    "seq": """SELECT client_id, prediction_day, churn_probability, risk_level,
                     row_number() OVER (PARTITION BY client_id ORDER BY prediction_day) AS rn FROM daily""",
    "fold": """SELECT client_id, rn, prediction_day, churn_probability, risk_level, risk_level AS confirmed_level
               FROM seq WHERE rn = 1
               UNION ALL
               SELECT s.client_id, s.rn, s.prediction_day, s.churn_probability, s.risk_level,
                      CASE WHEN s.risk_level = 'critical' AND f.confirmed_level NOT IN ('critical', 'high') THEN 'high'
                           WHEN s.risk_level = 'high' AND f.confirmed_level = 'low' THEN 'medium'
                           ELSE s.risk_level END
               FROM seq s JOIN fold f ON s.client_id = f.client_id AND s.rn = f.rn + 1"""}))
def confirm_levels(spark, sf):
    """Two-strike confirmation over each client's daily series."""
    d = daily(spark, sf).select("client_id", "prediction_day", "churn_probability", "risk_level")
    return H.confirm_levels(d, "client_id")


@query("previous_level", with_views(f"""
SELECT n.client_id, n.prediction_day, n.risk_level, h.prediction_day AS previous_day, h.risk_level AS previous_level
FROM (SELECT * FROM daily WHERE prediction_day = DATE '{BATCH_DAY}') n
LEFT JOIN (SELECT client_id, prediction_day, risk_level,
                  row_number() OVER (PARTITION BY client_id ORDER BY prediction_day DESC) AS rn
           FROM daily WHERE prediction_day < DATE '{BATCH_DAY}') h
  ON h.client_id = n.client_id AND h.rn = 1""", "daily"))
def previous_level(spark, sf):
    """The batch of the last day against each client's latest earlier day."""
    d = daily(spark, sf)
    new = d.filter(F.col("prediction_day") == F.to_date(F.lit(BATCH_DAY))).select(
        "client_id", "prediction_day", "risk_level")
    return H.previous_level(new, d, "client_id", BATCH_DAY)


@query("high_risk_clients", with_views("""
SELECT client_id, max(churn_probability) AS max_probability,
       arg_max(risk_level, churn_probability) AS risk_level,
       arg_max(risk_score, churn_probability) AS risk_score,
       max(prediction_date) AS last_prediction_date
FROM spreds WHERE churn_probability >= 0.5 GROUP BY client_id""", "spreds"))
def high_risk_clients(spark, sf):
    return S.high_risk_clients(scored_predictions(spark, sf), 0.5)


@query("prediction_stats", with_views("""
SELECT d.risk_level, d.latest_count, t.total_predictions, t.unique_clients_scored, r.total_prediction_runs
FROM (SELECT risk_level, count(*) AS latest_count FROM spreds p
      WHERE client_id IS NOT NULL
        AND prediction_date = (SELECT max(prediction_date) FROM spreds p2 WHERE p2.client_id = p.client_id)
      GROUP BY risk_level) d,
     (SELECT count(*) AS total_predictions, count(DISTINCT client_id) AS unique_clients_scored FROM spreds) t,
     (SELECT count(*) AS total_prediction_runs FROM runs) r""", "spreds", "runs"))
def prediction_stats(spark, sf):
    p = scored_predictions(spark, sf)
    return S.prediction_stats(p, H.latest_with_ties(p, "client_id"), H.runs_from_predictions(p))


@query("run_level_counts", with_views("""
SELECT run_day, model_version, high_risk_count, medium_risk_count, low_risk_count FROM runs""", "runs"))
def run_level_counts(spark, sf):
    return S.run_level_counts(scored_predictions(spark, sf))


@query("recent_runs", with_views("""
SELECT * FROM runs ORDER BY start_time DESC, model_version DESC LIMIT 10""", "runs"))
def recent_runs(spark, sf):
    """the ten most recent runs (a top-k report)."""
    return S.recent_runs(H.runs_from_predictions(scored_predictions(spark, sf)), 10)


@query("feedback_summary", with_views(f"""
SELECT count(*) AS total_feedback,
       CAST(sum(CASE WHEN actually_churned THEN 1 ELSE 0 END) AS BIGINT) AS true_positives,
       CAST(sum(CASE WHEN NOT actually_churned THEN 1 ELSE 0 END) AS BIGINT) AS false_positives,
       round(sum(CASE WHEN NOT actually_churned THEN 1 ELSE 0 END) / NULLIF(count(*), 0), 3) AS false_positive_rate,
       round(sum(CASE WHEN actually_churned THEN 1 ELSE 0 END) / NULLIF(count(*), 0), 3) AS actual_precision
FROM fb_dedup WHERE feedback_date >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY""", "fb_dedup"))
def feedback_summary(spark, sf):
    return S.feedback_summary(S.feedback_dedup(A.feedback(spark, sf)), AS_OF, 90)


@query("false_positive_rate", with_views(f"""
SELECT count(*) AS feedback_count,
       count(*) FILTER (WHERE actually_churned) AS true_positives,
       count(*) - count(*) FILTER (WHERE actually_churned) AS false_positives,
       CASE WHEN count(*) > 0 THEN (count(*) - count(*) FILTER (WHERE actually_churned)) / count(*) ELSE 0.0 END
           AS false_positive_rate,
       CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE actually_churned) / count(*) ELSE 0.0 END
           AS precision_actual,
       CAST(30 AS BIGINT) AS lookback_days,
       CASE WHEN count(*) = 0 THEN 'No feedback data yet' END AS message
FROM fb_dedup WHERE feedback_date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""", "fb_dedup"))
def false_positive_rate(spark, sf):
    return S.false_positive_rate(S.feedback_dedup(A.feedback(spark, sf)), AS_OF, 30)


@query("top_at_risk", with_views("""
SELECT client_id, client_name, churn_probability, risk_level, risk_score FROM latest_cp
ORDER BY churn_probability DESC, client_id ASC LIMIT 10""", "latest_cp"))
def top_at_risk(spark, sf):
    """the ten clients most at risk (a top-k report)."""
    return S.top_at_risk(latest_cp(spark, sf), 10).select(
        "client_id", "client_name", "churn_probability", "risk_level", "risk_score")


@query("search_clients", with_views("""
SELECT client_id, client_name, industry_type, churn_probability, risk_level FROM latest_cp
WHERE (contains(lower(client_name), 'build') OR contains(lower(industry_type), 'build'))
  AND risk_level = 'medium'""", "latest_cp"))
def search_clients(spark, sf):
    """Search term 'bUiLd' (case-insensitive substring), level 'medium'."""
    return S.search(latest_cp(spark, sf), "bUiLd", "medium").select(
        "client_id", "client_name", "industry_type", "churn_probability", "risk_level")


@query("risk_distribution", with_views("""
SELECT risk_level, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM spreds GROUP BY risk_level""", "spreds"))
def risk_distribution(spark, sf):
    """Bands over every prediction row."""
    return S.risk_distribution(scored_predictions(spark, sf))


@query("dashboard_cards", with_views("""
SELECT count(*) AS total,
       count(*) FILTER (WHERE risk_level = 'critical') AS critical,
       count(*) FILTER (WHERE risk_level = 'high') AS high,
       count(*) FILTER (WHERE risk_level = 'medium') AS medium,
       count(*) FILTER (WHERE risk_level = 'low') AS low,
       round((count(*) FILTER (WHERE risk_level = 'critical') + count(*) FILTER (WHERE risk_level = 'high'))
             / NULLIF(count(*), 0), 6) AS at_risk_share
FROM latest_cp""", "latest_cp"))
def dashboard_cards(spark, sf):
    return S.dashboard_cards(latest_cp(spark, sf))


@query("orphans", with_views("""
SELECT p.* FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM clients c WHERE c.id = p.client_id)""",
                             "predictions", "clients"))
def orphans(spark, sf):
    """Predictions whose client does not exist."""
    return H.orphans(A.predictions(spark, sf), A.clients(spark, sf), "client_id")


@query("validate_predictions", with_views("""
SELECT count(*) AS total_rows,
       count(*) FILTER (WHERE churn_probability BETWEEN 0 AND 1 AND risk_score BETWEEN 0 AND 100
                        AND risk_level IN ('low', 'medium', 'high', 'critical')) AS valid_rows,
       count(*) FILTER (WHERE NOT (churn_probability BETWEEN 0 AND 1 AND risk_score BETWEEN 0 AND 100
                        AND risk_level IN ('low', 'medium', 'high', 'critical'))) AS quarantined_rows
FROM spreds""", "spreds"))
def validate_predictions(spark, sf):
    """Valid vs quarantined prediction rows."""
    return H.validation_counts(scored_predictions(spark, sf))


@query("attendance_window", with_views(f"""
SELECT * FROM attendance WHERE date >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY""", "attendance"))
def attendance_window(spark, sf):
    """Attendance rows of the 90 days before the as-of instant."""
    from staywise.sources.ingest import scan_attendance
    return scan_attendance(A.attendance(spark, sf), AS_OF, 90)


@query("risk_bands", with_views(f"""
SELECT id, churn_probability,
       {level_sql('churn_probability')} AS level_strict,
       {level_sql('churn_probability', (0.25, 0.5, 0.75))} AS level_wide,
       CASE WHEN churn_probability > 0 AND churn_probability <= 0.4 THEN 'low'
            WHEN churn_probability > 0.4 AND churn_probability <= 0.65 THEN 'medium'
            WHEN churn_probability > 0.65 AND churn_probability <= 0.85 THEN 'high'
            WHEN churn_probability > 0.85 AND churn_probability <= 1.0 THEN 'critical' END AS level_cut,
       CAST(trunc(churn_probability * 100) AS BIGINT) AS risk_score,
       CASE WHEN churn_probability > 0.3
            THEN CAST(trunc(greatest(7.0, 180.0 * (1 - churn_probability))) AS BIGINT) END AS predicted_days
FROM predictions""", "predictions"))
def risk_bands(spark, sf):
    """Both ladders, the right-closed cut, score and predicted days."""
    from staywise.functions import risk as R
    p = A.predictions(spark, sf)
    return p.select("id", "churn_probability", R.risk_level("churn_probability").alias("level_strict"),
                    R.risk_level("churn_probability", R.WIDE_BANDS).alias("level_wide"),
                    R.risk_cut("churn_probability").alias("level_cut"),
                    R.risk_score("churn_probability").alias("risk_score"),
                    R.predicted_days("churn_probability").alias("predicted_days"))
