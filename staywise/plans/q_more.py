"""Registered queries: dashboard views, name filters, alignment, nested
records and distinct values."""

from __future__ import annotations

from pyspark.sql import functions as F

from staywise.operators import features as FT
from staywise.operators import history as H
from staywise.operators import rules as R
from staywise.operators import summary as S
from staywise.plans.oracle_views import with_views
from staywise.plans.q_features import AS_OF as ACC_AS_OF, FORM_FEATURES_SQL, TRAINING_DATA_SQL
from staywise.plans.q_history import latest_cp
from staywise.plans.q_metrics import CF_EXTRA, CHURN_RULE_4, CHURN_RULES, CLIENT_BASE_SQL
from staywise.plans.registry import ORACLE, query
from staywise.sources import adapters as A
from staywise.sources import ingest as I

NAMES = "Customer#000000001, Customer#000000005 ,Customer#000000010,Nobody"


@query("risk_map", with_views("""
SELECT l.client_id, l.client_name, l.industry_type AS industry, l.client_location AS region, f.tenure_months,
       l.risk_score, l.risk_level
FROM latest_cp l JOIN cf f ON f.id = l.client_id""", "latest_cp", extra=CF_EXTRA))
def risk_map(spark, sf):
    """The risk scatter of active clients (search term empty, level all)."""
    lat = S.search(latest_cp(spark, sf), "", "all")
    return S.risk_map(lat, FT.client_features(A.clients(spark, sf), ACC_AS_OF))


def _at_risk_sql(n: int) -> str:
    parts = [f"SELECT client_id, {i + 1} AS rule, '{f}' AS factor, {imp} AS impact, {desc} AS description "
             f"FROM base WHERE {cond}" for i, (cond, f, imp, desc) in enumerate(CHURN_RULES + [CHURN_RULE_4])]
    return with_views(f"""
SELECT t.client_id, t.risk_level, CAST(r.pos - 1 AS BIGINT) AS factor_pos, r.factor, r.impact, r.description
FROM (SELECT client_id, risk_level FROM latest_cp WHERE risk_level IN ('critical', 'high')
      ORDER BY churn_probability DESC, client_id ASC LIMIT {n}) t
JOIN (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY
             CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, rule) AS pos
      FROM ({' UNION ALL '.join(parts)}) u) r ON r.client_id = t.client_id AND r.pos <= 3""",
                      "latest_cp", extra={**CF_EXTRA, "base": CLIENT_BASE_SQL})


@query("at_risk_reasons", _at_risk_sql(5))
def at_risk_reasons(spark, sf):
    """The first five critical/high clients, one row per factor."""
    lat = latest_cp(spark, sf)
    feats = FT.client_features(A.clients(spark, sf), ACC_AS_OF).withColumnRenamed("id", "client_id")
    base = lat.join(feats, "client_id", "inner")
    withf = R.churn_factors(base, "training", 3)
    out = S.at_risk_reasons(withf, 5)
    return out.select("client_id", "risk_level", "factor_pos", F.col("factor.factor").alias("factor"),
                      F.col("factor.impact").alias("impact"), F.col("factor.description").alias("description"))


@query("filter_names", with_views(f"""
SELECT id, name FROM clients WHERE is_active = true
  AND name IN ({', '.join(repr(n.strip()) for n in NAMES.split(','))})""", "clients"))
def filter_names(spark, sf):
    """Comma list, trimmed, exact match, over the active-client scan."""
    return S.filter_names(I.scan_clients(A.clients(spark, sf), True), NAMES, "name").select("id", "name")


ALIGNED = FT.TRAINING_MATRIX_12 + ("tm_tenure_months",)


@query("align_features", ORACLE["scoring_matrix_12"].replace(
    "365.0 AS client_tenure_at_termination, 0.0 AS termination_type_encoded, 0.0 AS geo_encoded",
    "365.0 AS client_tenure_at_termination, 0.0 AS termination_type_encoded, 0.0 AS geo_encoded, "
    "CAST(0 AS BIGINT) AS tm_tenure_months").replace("SELECT c.id AS client_id, c.name AS client_name,",
                                                     "SELECT c.id AS client_id,"))
def align_features(spark, sf):
    """Scoring rows in the model's column order, missing columns as 0."""
    active = I.scan_clients(A.clients(spark, sf), active_only=True)
    t = A.terminations(spark, sf)
    sm = FT.scoring_matrix(active, FT.training_data(t))
    return FT.align_features(sm, ALIGNED, keep=("client_id",))


@query("drop_zero_importance", with_views("""
SELECT id, days_since_communication, days_since_checkin, checkin_frequency_encoded, no_replacement,
       replacement_urgency, had_pip, offered_discount FROM ff""", "terminations",
                                          extra={"ff": FORM_FEATURES_SQL.replace("id AS termination_id", "id")}))
def drop_zero_importance(spark, sf):
    """Form features without the columns whose importance is zero."""
    f = FT.form_features(A.terminations(spark, sf)).withColumnRenamed("termination_id", "id")
    return FT.drop_zero_importance(f, ("health_score", "team_member_tenure_days", "client_tenure_at_termination"))


@query("embed_client", with_views("""
SELECT m.id, m.first_name, m.client_id, c.id AS client_ref, c.name AS client_name, c.industry_type AS client_industry
FROM team_members m LEFT JOIN clients c ON c.id = m.client_id""", "team_members", "clients"))
def embed_client(spark, sf):
    """Members with their client as a nested record (fields selected)."""
    e = H.embed_client(A.team_members(spark, sf), A.clients(spark, sf))
    return e.select("id", "first_name", "client_id", F.col("clients.id").alias("client_ref"),
                    F.col("clients.name").alias("client_name"), F.col("clients.industry_type").alias("client_industry"))


@query("distinct_client_names", with_views("SELECT DISTINCT client_name FROM terminations", "terminations"))
def distinct_client_names(spark, sf):
    """G4."""
    return S.distinct_values(A.terminations(spark, sf), "client_name")


@query("last_record_per_client", with_views("""
SELECT id, client_name, notice_date, days_since_communication, days_since_checkin FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(client_name) ORDER BY notice_date DESC, id DESC) AS rn
  FROM td WHERE client_name IS NOT NULL) x WHERE rn = 1""", "terminations",
                                            extra={"ff": FORM_FEATURES_SQL, "td": TRAINING_DATA_SQL}))
def last_record_per_client(spark, sf):
    """E5: each client's last termination row (order: notice date, then id)."""
    t = A.terminations(spark, sf)
    td = FT.training_data(t).withColumn("name_key", F.lower("client_name"))
    last = H.latest(td.filter(F.col("name_key").isNotNull()), "name_key", ("notice_date", "id"))
    return last.select("id", "client_name", "notice_date", "days_since_communication", "days_since_checkin")
