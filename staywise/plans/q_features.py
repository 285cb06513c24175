"""Registered queries: labels, encoders and feature pipelines (paths 1 and 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from staywise.operators import features as FT
from staywise.operators import labels as L
from staywise.operators.encode import factorize, fit_transform
from staywise.plans.oracle_views import with_views
from staywise.plans.registry import query
from staywise.sources import adapters as A
from staywise.sources import ingest as I

AS_OF = A.AS_OF_ACCOUNTS
PENDING_CUT = "1998-01-01 00:00:00"   # features of notices before this were computed by an earlier batch


def B(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def DAYS(a: str, b: str) -> str:
    return (f"CAST(floor((epoch_us(CAST({b} AS TIMESTAMP)) - epoch_us(CAST({a} AS TIMESTAMP))) "
            f"/ 86400000000) AS BIGINT)")


def BOOL(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 0 WHEN TRY_CAST({x} AS DOUBLE) IS NOT NULL "
            f"THEN CAST(TRY_CAST({x} AS DOUBLE) <> 0 AS INTEGER) "
            f"WHEN lower(trim({x})) IN ('yes', 'true', '1', 'y', 'x') THEN 1 ELSE 0 END")


def CLIP(x: str, lo, hi, d) -> str:
    return f"least(greatest(coalesce({x}, {d}), {lo}), {hi})"


REF = f"TIMESTAMP '{AS_OF}'"

FORM_FEATURES_SQL = f"""
SELECT id AS termination_id,
       coalesce({DAYS('last_comm_date', 'notice_date')}, 999) AS days_since_communication,
       coalesce({DAYS('last_checkin_date', 'notice_date')}, 999) AS days_since_checkin,
       coalesce({DAYS('tm_start_date', 'tm_last_date')}, 0) AS team_member_tenure_days,
       coalesce({DAYS('client_start_date', 'notice_date')}, 0) AS client_tenure_at_termination,
       {B("CASE lower(coalesce(health_text, 'none')) WHEN 'excellent' THEN 4 WHEN 'good' THEN 3 "
          "WHEN 'fair' THEN 2 WHEN 'poor' THEN 1 ELSE 0 END")} AS health_score,
       {B("CASE lower(coalesce(check_in_cadence, 'none')) WHEN 'weekly' THEN 1 WHEN 'bi-weekly' THEN 2 "
          "WHEN 'bi-monthly' THEN 2 WHEN 'monthly' THEN 3 ELSE 4 END")} AS checkin_frequency_encoded,
       {B('1 - (' + BOOL('will_have_replacement') + ')')} AS no_replacement,
       {B("CASE WHEN contains(lower(coalesce(replacement_timeframe, '')), 'immediate') THEN 3 "
          "WHEN contains(lower(coalesce(replacement_timeframe, '')), 'asap') THEN 3 "
          "WHEN contains(lower(coalesce(replacement_timeframe, '')), '1-2 weeks') THEN 2 "
          "WHEN contains(lower(coalesce(replacement_timeframe, '')), '2-4 weeks') THEN 1 "
          "WHEN contains(lower(coalesce(replacement_timeframe, '')), '1 week') THEN 2 ELSE 0 END")} AS replacement_urgency,
       {B(BOOL('pip_implemented'))} AS had_pip,
       {B(BOOL('relief_offered'))} AS offered_discount
FROM terminations"""

TRAINING_DATA_SQL = f"""
SELECT t.id, t.client_name, t.notice_date, t.termination_reason, t.geo_location,
       {B('coalesce(' + BOOL('t.client_lost') + ', 0)')} AS client_lost,
       t.seat_count AS current_seat_count,
       f.days_since_communication, f.days_since_checkin, f.team_member_tenure_days,
       f.client_tenure_at_termination, f.health_score, f.checkin_frequency_encoded, f.no_replacement,
       f.replacement_urgency, f.had_pip, f.offered_discount
FROM terminations t JOIN ff f ON f.termination_id = t.id
WHERE t.notice_date IS NOT NULL"""


def _vocab_sql(src: str, col: str, fill: str) -> str:
    return (f"SELECT v, {B('dense_rank() OVER (ORDER BY v) - 1')} AS code "
            f"FROM (SELECT DISTINCT coalesce(CAST({col} AS VARCHAR), '{fill}') AS v FROM {src}) d")


def _factor_sql(src: str, col: str, fill: str) -> str:
    return (f"SELECT v, {B('dense_rank() OVER (ORDER BY first_id, v) - 1')} AS code "
            f"FROM (SELECT coalesce({col}, '{fill}') AS v, min(id) AS first_id FROM {src} GROUP BY 1) d")


@query("label_client_churn", with_views("""
SELECT id, CAST(coalesce(attrition_date IS NOT NULL OR lower(status) = 'inactive' OR is_active = false, false)
                AS BIGINT) AS churned
FROM clients""", "clients"))
def label_client_churn(spark, sf):
    """B2."""
    return L.label_client_churn(A.clients(spark, sf)).select("id", "churned")


@query("label_member_attrition", with_views("""
SELECT id, CAST(NOT (lower(status) IS NOT DISTINCT FROM 'active') AS BIGINT) AS "left" FROM team_members""",
                                            "team_members"))
def label_member_attrition(spark, sf):
    """B3."""
    return L.label_member_attrition(A.team_members(spark, sf)).select("id", "left")


@query("label_encode", with_views(f"""
SELECT c.id, c.industry_type, v.code AS industry_encoded
FROM clients c JOIN ({_vocab_sql('clients', 'industry_type', 'OTHER')}) v
  ON v.v = coalesce(c.industry_type, 'OTHER')""", "clients"))
def label_encode_q(spark, sf):
    """Alphabetical codes of the client industry."""
    return fit_transform(A.clients(spark, sf).select("id", "industry_type"), "industry_type",
                         "industry_encoded", "OTHER")


@query("factorize", with_views(f"""
SELECT c.id, c.client_location, v.code AS location_encoded
FROM clients c JOIN ({_factor_sql('clients', 'client_location', 'Unknown')}) v
  ON v.v = coalesce(c.client_location, 'Unknown')""", "clients"))
def factorize_q(spark, sf):
    """Client location coded by first appearance in id order."""
    return factorize(A.clients(spark, sf).select("id", "client_location"), "client_location",
                     "location_encoded", "id", "Unknown")


@query("form_features", with_views(FORM_FEATURES_SQL, "terminations"))
def form_features(spark, sf):
    """J1."""
    return FT.form_features(A.terminations(spark, sf))


def _v2_sql(keep: int) -> str:
    cols13 = ", ".join(FT.FORM_V2_13)
    cols9 = ", ".join(FT.FORM_V2_9)
    return with_views(f"""
SELECT id, {cols13 if keep == 13 else cols9}, churned FROM (
SELECT l.id, l.churned,
       1 - coalesce(CASE l.will_have_replacement WHEN 'Yes' THEN 1.0 WHEN 'No' THEN 0.0 WHEN 'TBA' THEN 0.5 END, 0.5)
           AS no_replacement,
       {CLIP('l.seat_count', '0.0', '50.0', '1.0')} AS current_seat_count,
       coalesce(TRY_CAST(l.health_text AS DOUBLE), 3.0) AS health_score,
       {B("CASE l.check_in_cadence WHEN 'Daily' THEN 4 WHEN 'Weekly' THEN 3 WHEN 'Bi-Monthly' THEN 2 "
          "WHEN 'Monthly' THEN 1 ELSE 2 END")} AS checkin_frequency,
       vt.code AS termination_type_encoded,
       {CLIP(DAYS('l.last_checkin_date', 'l.notice_date'), 0, 180, 14)} AS days_since_checkin,
       {CLIP(DAYS('l.last_comm_date', 'l.notice_date'), 0, 180, 14)} AS days_since_communication,
       {CLIP(DAYS('l.client_start_date', 'l.notice_date') + ' / 30.0', '0.0', '120.0', '12.0')} AS client_tenure_months,
       {CLIP(DAYS('l.tm_start_date', 'l.notice_date') + ' / 30.0', '0.0', '60.0', '6.0')} AS tm_tenure_months,
       {B("coalesce(l.pip_implemented = 'Yes', false)")} AS had_pip,
       {B("coalesce(l.relief_offered = 'Yes', false)")} AS offered_discount,
       vg.code AS geo_encoded, vu.code AS replacement_urgency
FROM lab l
JOIN vt ON vt.v = coalesce(l.termination_reason, 'Unknown')
JOIN vg ON vg.v = coalesce(l.geo_location, 'Unknown')
JOIN vu ON vu.v = coalesce(l.replacement_timeframe, 'Unknown')) x""", "terminations", extra={
        "lab": "SELECT *, CASE WHEN client_lost = 'Yes' THEN 1 WHEN client_lost = 'No' THEN 0 END AS churned "
               "FROM terminations WHERE client_lost IN ('Yes', 'No')",
        "vt": _vocab_sql("lab", "termination_reason", "Unknown"),
        "vg": _vocab_sql("lab", "geo_location", "Unknown"),
        "vu": _vocab_sql("lab", "replacement_timeframe", "Unknown"),
    })


@query("form_features_13", _v2_sql(13))
def form_features_13(spark, sf):
    """J2 over labelled termination rows (A3)."""
    return FT.form_features_v2(I.load_labeled(A.terminations(spark, sf)), 13)


@query("form_features_9", _v2_sql(9))
def form_features_9(spark, sf):
    """J3."""
    return FT.form_features_v2(I.load_labeled(A.terminations(spark, sf)), 9)


CLIENT_FEATURES_SQL = f"""
SELECT c.id,
       coalesce(CAST(trunc({DAYS('coalesce(c.start_date, c.created_at)', REF)} / 30.0) AS BIGINT), 0) AS tenure_months,
       {B("CASE lower(coalesce(c.health, 'unknown')) WHEN 'excellent' THEN 4 WHEN 'good' THEN 3 WHEN 'fair' THEN 2 "
          "WHEN 'poor' THEN 1 WHEN 'unknown' THEN 2 ELSE 2 END")} AS health_score,
       {CLIP(DAYS('c.updated_at', REF), 0, 365, 30)} AS days_since_activity,
       vi.code AS industry_encoded, vl.code AS location_encoded,
       {B('coalesce(c.is_active, true)')} AS is_active,
       {B('coalesce(month(coalesce(c.start_date, c.created_at)), 1)')} AS start_month,
       {B('coalesce(quarter(coalesce(c.start_date, c.created_at)), 1)')} AS start_quarter,
       {CLIP(DAYS('coalesce(c.start_date, c.created_at)', REF), 0, 3650, 0)} AS days_since_start
FROM clients c
JOIN vi ON vi.v = coalesce(c.industry_type, 'OTHER')
JOIN vl ON vl.v = coalesce(c.client_location, 'Unknown')"""


@query("client_features", with_views(CLIENT_FEATURES_SQL, "clients", extra={
    "vi": _vocab_sql("clients", "industry_type", "OTHER"),
    "vl": _vocab_sql("clients", "client_location", "Unknown")}))
def client_features(spark, sf):
    """J4 at the accounts as-of instant."""
    return FT.client_features(A.clients(spark, sf), AS_OF)


MEMBER_FEATURES_SQL = f"""
SELECT id, tenure_months, role_encoded, days_since_activity, has_client,
       {B("CASE WHEN tenure_months > -1 AND tenure_months <= 3 THEN 0 WHEN tenure_months > 3 AND tenure_months <= 6 THEN 1 "
          "WHEN tenure_months > 6 AND tenure_months <= 12 THEN 2 WHEN tenure_months > 12 AND tenure_months <= 24 THEN 3 "
          "WHEN tenure_months > 24 AND tenure_months <= 999 THEN 4 END")} AS tenure_bucket,
       {B('tenure_months <= 3')} AS is_new_employee, start_month, start_day_of_week
FROM (SELECT m.id,
             coalesce(CAST(trunc({DAYS('coalesce(m.start_date, m.created_at)', REF)} / 30.0) AS BIGINT), 0) AS tenure_months,
             vr.code AS role_encoded,
             {CLIP(DAYS('m.updated_at', REF), 0, 365, 7)} AS days_since_activity,
             {B('m.client_id IS NOT NULL')} AS has_client,
             {B('coalesce(month(coalesce(m.start_date, m.created_at)), 1)')} AS start_month,
             {B('coalesce(isodow(coalesce(m.start_date, m.created_at)) - 1, 0)')} AS start_day_of_week
      FROM team_members m JOIN vr ON vr.v = coalesce(m.role, 'team_member')) x"""


@query("member_features", with_views(MEMBER_FEATURES_SQL, "team_members", extra={
    "vr": _vocab_sql("team_members", "role", "team_member")}))
def member_features(spark, sf):
    """J5 at the accounts as-of instant."""
    return FT.member_features(A.team_members(spark, sf), AS_OF)


@query("simple_client_features", with_views(f"""
SELECT c.id,
       coalesce(CAST(trunc({DAYS('coalesce(c.start_date, c.created_at)', REF)} / 30.0) AS BIGINT), 0) AS tenure_months,
       {B("CASE lower(c.health) WHEN 'excellent' THEN 4 WHEN 'good' THEN 3 WHEN 'fair' THEN 2 WHEN 'poor' THEN 1 ELSE 2 END")}
           AS health_score,
       {CLIP(DAYS('c.updated_at', REF), 0, 365, 30)} AS days_since_activity,
       fi.code AS industry_encoded, fl.code AS location_encoded
FROM clients c
JOIN fi ON fi.v = coalesce(c.industry_type, 'OTHER')
JOIN fl ON fl.v = coalesce(c.client_location, 'Unknown')""", "clients", extra={
    "fi": _factor_sql("clients", "industry_type", "OTHER"),
    "fl": _factor_sql("clients", "client_location", "Unknown")}))
def simple_client_features(spark, sf):
    """J8 (clients)."""
    return FT.simple_client_features(A.clients(spark, sf), AS_OF)


@query("simple_member_features", with_views(f"""
SELECT m.id, t.tenure_months, fr.code AS role_encoded,
       {CLIP(DAYS('m.updated_at', REF), 0, 365, 7)} AS days_since_activity,
       {B('m.client_id IS NOT NULL')} AS has_client, {B('t.tenure_months <= 3')} AS is_new_employee
FROM team_members m
JOIN (SELECT id, coalesce(CAST(trunc({DAYS('coalesce(start_date, created_at)', REF)} / 30.0) AS BIGINT), 0)
             AS tenure_months FROM team_members) t ON t.id = m.id
JOIN fr ON fr.v = coalesce(m.role, 'team_member')""", "team_members", extra={
    "fr": _factor_sql("team_members", "role", "team_member")}))
def simple_member_features(spark, sf):
    """J8 (members)."""
    return FT.simple_member_features(A.team_members(spark, sf), AS_OF)


@query("training_data", with_views(TRAINING_DATA_SQL, "terminations", extra={"ff": FORM_FEATURES_SQL}))
def training_data(spark, sf):
    """Terminations joined to their computed features."""
    t = A.terminations(spark, sf)
    return FT.training_data(t)


@query("pending_features", with_views(f"""
SELECT t.* FROM terminations t
WHERE NOT EXISTS (SELECT 1 FROM terminations e WHERE e.id = t.id AND e.notice_date < TIMESTAMP '{PENDING_CUT}')""",
                                      "terminations"))
def pending_features(spark, sf):
    """Terminations whose features were not computed by the earlier batch
    (the one that covered notices before 1998)."""
    t = A.terminations(spark, sf)
    done = FT.form_features(t.filter(F.col("notice_date") < F.to_timestamp_ntz(F.lit(PENDING_CUT))))
    return FT.pending_features(t, done)


TRAINING_MATRIX_SQL = f"""
SELECT d.id, d.client_name, d.notice_date,
       {CLIP('CAST(d.days_since_communication AS DOUBLE)', '0.0', '999.0', '0.0')} AS days_since_communication,
       {CLIP('CAST(d.days_since_checkin AS DOUBLE)', '0.0', '999.0', '0.0')} AS days_since_checkin,
       coalesce(CAST(d.health_score AS DOUBLE), 0.0) AS health_score,
       coalesce(CAST(d.checkin_frequency_encoded AS DOUBLE), 0.0) AS checkin_frequency_encoded,
       coalesce(CAST(d.no_replacement AS DOUBLE), 0.0) AS no_replacement,
       coalesce(CAST(d.replacement_urgency AS DOUBLE), 0.0) AS replacement_urgency,
       coalesce(CAST(d.had_pip AS DOUBLE), 0.0) AS had_pip,
       coalesce(CAST(d.offered_discount AS DOUBLE), 0.0) AS offered_discount,
       coalesce(CAST(d.current_seat_count AS DOUBLE), 0.0) AS current_seat_count,
       coalesce(CAST(d.client_tenure_at_termination AS DOUBLE), 0.0) AS client_tenure_at_termination,
       CAST(0 AS BIGINT) AS termination_type_encoded, vg.code AS geo_encoded,
       coalesce(CAST(d.client_lost AS DOUBLE), 0.0) AS client_lost
FROM td d
JOIN vg ON vg.v = coalesce(d.geo_location, 'Unknown')"""


@query("training_matrix_12", with_views(TRAINING_MATRIX_SQL, "terminations", extra={
    "ff": FORM_FEATURES_SQL, "td": TRAINING_DATA_SQL, "vg": _vocab_sql("td", "geo_location", "Unknown")}))
def training_matrix_12(spark, sf):
    """J6."""
    t = A.terminations(spark, sf)
    return FT.training_matrix(FT.training_data(t))


SCORING_SELECT = f"""
SELECT c.id AS client_id, c.name AS client_name,
       CASE WHEN h.name_key IS NOT NULL THEN CAST(h.days_since_communication AS DOUBLE)
            WHEN hs.s >= 3 THEN 14.0 ELSE 30.0 END AS days_since_communication,
       CASE WHEN h.name_key IS NOT NULL THEN CAST(h.days_since_checkin AS DOUBLE)
            WHEN hs.s >= 3 THEN 7.0 ELSE 21.0 END AS days_since_checkin,
       CAST(hs.s AS DOUBLE) AS health_score,
       CASE WHEN h.name_key IS NOT NULL THEN CAST(h.checkin_frequency_encoded AS DOUBLE) ELSE 2.0 END
           AS checkin_frequency_encoded,
       0.0 AS no_replacement, 0.0 AS replacement_urgency, 0.0 AS had_pip, 0.0 AS offered_discount,
       CASE WHEN h.name_key IS NULL THEN 1.0
            WHEN coalesce(h.current_seat_count, 1.0) = 0 THEN 1.0
            ELSE CAST(trunc(coalesce(h.current_seat_count, 1.0)) AS DOUBLE) END AS current_seat_count,
       365.0 AS client_tenure_at_termination, 0.0 AS termination_type_encoded, 0.0 AS geo_encoded
FROM clients c
JOIN (SELECT id, CASE lower(coalesce(health, 'none')) WHEN 'excellent' THEN 4 WHEN 'good' THEN 3
                     WHEN 'fair' THEN 2 WHEN 'poor' THEN 1 ELSE 2 END AS s FROM clients) hs ON hs.id = c.id
LEFT JOIN (SELECT * FROM (SELECT lower(client_name) AS name_key, days_since_communication, days_since_checkin,
                                 checkin_frequency_encoded, current_seat_count,
                                 row_number() OVER (PARTITION BY lower(client_name)
                                                    ORDER BY notice_date DESC, id DESC) AS rn
                          FROM td WHERE client_name IS NOT NULL) z WHERE rn = 1) h
  ON h.name_key = lower(c.name)
WHERE c.is_active = true"""


@query("scoring_matrix_12", with_views(SCORING_SELECT, "terminations", "clients", extra={"ff": FORM_FEATURES_SQL, "td": TRAINING_DATA_SQL}))
def scoring_matrix_12(spark, sf):
    """Active clients, features from their last termination row or defaults."""
    t = A.terminations(spark, sf)
    active = I.scan_clients(A.clients(spark, sf), active_only=True)
    return FT.scoring_matrix(active, FT.training_data(t))


@query("scan_clients", with_views("""
SELECT id, name, industry_type, client_location, start_date, status, is_active, health, attrition_date,
       created_at, updated_at FROM clients WHERE is_active = true""", "clients"))
def scan_clients(spark, sf):
    """Active clients, client projection."""
    return I.scan_clients(A.clients(spark, sf), active_only=True)


@query("scan_team_members", with_views("""
SELECT id, first_name, last_name, role, status, start_date, client_id, created_at, updated_at
FROM team_members""", "team_members"))
def scan_team_members(spark, sf):
    """A7 (all members; the exact 'active' filter is a parameter)."""
    return I.scan_team_members(A.team_members(spark, sf), active_only=False)


@query("attrition_history_union", with_views("""
SELECT id, name, industry_type, client_location, start_date, created_at, updated_at, health, status, is_active,
       attrition_date, 'client' AS entity_type, NULL AS first_name, NULL AS last_name, NULL AS role,
       CAST(NULL AS BIGINT) AS client_id
FROM clients WHERE lower(status) = 'inactive'
UNION ALL
SELECT id, NULL, NULL, NULL, start_date, created_at, updated_at, NULL, status, NULL, NULL, 'team_member',
       first_name, last_name, role, client_id
FROM team_members WHERE NOT (lower(status) IS NOT DISTINCT FROM 'active')""", "clients", "team_members"))
def attrition_history_union(spark, sf):
    """A9/G1."""
    return I.attrition_history(A.clients(spark, sf), A.team_members(spark, sf))


@query("combined_sources", with_views("""
SELECT _source, count(*) AS n_rows, CAST(sum(churned) AS BIGINT) AS n_churned FROM (
  SELECT CASE WHEN id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS _source,
         CASE WHEN client_lost = 'Yes' THEN 1 WHEN client_lost = 'No' THEN 0 END AS churned
  FROM terminations) t WHERE churned IS NOT NULL GROUP BY _source""", "terminations"))
def combined_sources(spark, sf):
    """The two training sources (terminations split by id parity,
    as the fixtures define real vs synthetic rows), united and summarised."""
    from staywise.operators.summary import source_breakdown
    t = A.terminations(spark, sf)
    real = t.filter(F.col("id") % 2 == 0)
    synth = t.filter(F.col("id") % 2 != 0)
    return source_breakdown(I.load_combined(real, synth))


@query("training_stats", with_views(f"""
SELECT count(*) AS total_records,
       count(*) FILTER (WHERE ({BOOL('client_lost')}) = 1) AS churned_clients,
       count(DISTINCT client_name) AS unique_clients,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE ({BOOL('client_lost')}) = 1) / count(*), 6)
            ELSE 0.0 END AS churn_rate
FROM terminations""", "terminations"))
def training_stats(spark, sf):
    """Totals over the termination rows."""
    from staywise.operators.summary import training_stats as ts
    return ts(A.terminations(spark, sf))


@query("health_distribution", with_views("""
SELECT health_text AS health, count(*) AS n FROM terminations GROUP BY health_text""", "terminations"))
def health_distribution(spark, sf):
    """Rows per health answer, null as its own group."""
    from staywise.operators.summary import health_distribution as hd
    return hd(A.terminations(spark, sf))
