"""SQL text of the fixture views (FIXTURES.md part 2) for the DuckDB oracle.

These are the adapter definitions as plain SQL; ``with_views`` prefixes a
query with the views it needs as CTEs so each oracle string is
self-contained over the pre-registered base tables.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "clients": """
SELECT c.c_custkey AS id, c.c_name AS name, c.c_mktsegment AS industry_type, n.n_name AS client_location,
       CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE o.first_order END AS start_date,
       o.first_order AS created_at, o.last_order AS updated_at,
       CASE WHEN c.c_acctbal >= 7000 THEN 'excellent' WHEN c.c_acctbal >= 4000 THEN 'Good'
            WHEN c.c_acctbal >= 1000 THEN 'fair' WHEN c.c_acctbal >= 0 THEN 'poor' END AS health,
       CASE WHEN o.last_order >= TIMESTAMP '2000-08-01 00:00:00' THEN 'active' ELSE 'Inactive' END AS status,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE o.last_order >= TIMESTAMP '2000-08-01 00:00:00' END AS is_active,
       CASE WHEN o.last_order < TIMESTAMP '2000-06-01 00:00:00' THEN o.last_order END AS attrition_date
FROM customer c
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
           FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "team_members": """
SELECT s.s_suppkey AS id, concat('First', CAST(s.s_suppkey AS VARCHAR)) AS first_name,
       CASE WHEN s.s_suppkey % 9 = 0 THEN NULL ELSE s.s_name END AS last_name,
       CASE s.s_suppkey % 6 WHEN 0 THEN 'team_member' WHEN 1 THEN 'team_lead' WHEN 2 THEN 'manager'
            WHEN 3 THEN 'senior' WHEN 4 THEN 'junior' END AS role,
       CASE WHEN s.s_acctbal < 0 THEN NULL WHEN s.s_acctbal < 2500 THEN 'inactive' ELSE 'Active' END AS status,
       a.o_orderdate AS start_date, a.o_orderdate AS created_at, b.o_orderdate AS updated_at,
       CASE WHEN s.s_suppkey % 10 = 0 THEN NULL ELSE b.o_custkey END AS client_id
FROM supplier s
LEFT JOIN orders a ON a.o_orderkey = s.s_suppkey * 7
LEFT JOIN orders b ON b.o_orderkey = s.s_suppkey * 11 + 1""",
    "terminations": """
SELECT o.o_orderkey AS id, c.c_name AS client_name, o.o_orderdate AS notice_date,
       l.last_ship AS last_comm_date, l.first_ship AS last_checkin_date,
       f.first_order AS client_start_date, l.first_ship AS tm_start_date, l.last_ship AS tm_last_date,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Immediate' WHEN '2-HIGH' THEN '1-2 weeks'
            WHEN '3-MEDIUM' THEN '2-4 weeks' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'no rush' END AS replacement_timeframe,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Weekly' WHEN '2-HIGH' THEN 'Bi-Monthly'
            WHEN '3-MEDIUM' THEN 'Monthly' WHEN '4-NOT SPECIFIED' THEN 'Daily' END AS check_in_cadence,
       CASE WHEN o.o_totalprice < 100000 THEN 'poor' WHEN o.o_totalprice < 200000 THEN 'Fair'
            WHEN o.o_totalprice < 300000 THEN 'good' WHEN o.o_totalprice < 400000 THEN 'excellent' END AS health_text,
       CASE l.max_flag WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'No' WHEN 'R' THEN 'TBA' END AS will_have_replacement,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'Yes' WHEN o.o_orderkey % 7 < 4 THEN 'No' END AS pip_implemented,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'x' ELSE 'no' END AS relief_offered,
       l.seats AS seat_count, l.max_flag AS termination_reason, n.n_name AS geo_location,
       CASE o.o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' END AS client_lost
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) f ON f.o_custkey = o.o_custkey
LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
                  max(l_returnflag) AS max_flag, max(l_quantity) AS seats
           FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "predictions": """
SELECT event_id AS id, user_id AS client_id, ts AS prediction_date,
       value / (value + CAST(50 AS DOUBLE)) AS churn_probability,
       CASE WHEN event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version
FROM events""",
    "feedback": """
SELECT user_id AS client_id, CAST(ts AS DATE) AS prediction_date, ts AS feedback_date,
       event_type = 'error' AS actually_churned
FROM events WHERE event_type IN ('error', 'purchase')""",
    "attendance": """
SELECT event_id AS id, user_id AS team_member_id, ts AS date, value / CAST(50 AS DOUBLE) AS hours_worked, value < 20 AS is_late
FROM events WHERE event_type IN ('view', 'click')""",
    "scored": """
SELECT event_id AS id, value / (value + CAST(50 AS DOUBLE)) AS p, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events""",
}


def level_sql(p: str, bands=(0.40, 0.65, 0.85)) -> str:
    lo, mid, hi = bands
    return (f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} >= {hi} THEN 'critical' WHEN {p} >= {mid} THEN 'high' "
            f"WHEN {p} >= {lo} THEN 'medium' ELSE 'low' END")


def score_sql(p: str) -> str:
    return f"CAST(trunc({p} * 100) AS BIGINT)"


# scored predictions: the predictions view with strict levels and scores
EXTRA: dict[str, str] = {
    "spreds": f"""
SELECT id, client_id, prediction_date, churn_probability, model_version,
       {level_sql('churn_probability')} AS risk_level, {score_sql('churn_probability')} AS risk_score
FROM predictions""",
    "daily": f"""
SELECT id, client_id, prediction_date, churn_probability, model_version, prediction_day, risk_level, risk_score
FROM (SELECT s.*, CAST(prediction_date AS DATE) AS prediction_day,
             row_number() OVER (PARTITION BY client_id, CAST(prediction_date AS DATE)
                                ORDER BY prediction_date DESC, id DESC) AS rn
      FROM spreds s) t WHERE rn = 1""",
    "latest_cp": """
SELECT t.id, t.client_id, t.prediction_date, t.churn_probability, t.model_version, t.risk_level, t.risk_score,
       c.name AS client_name, c.industry_type, c.client_location, c.health, c.status AS client_status
FROM (SELECT s.*, row_number() OVER (PARTITION BY client_id ORDER BY prediction_date DESC, id DESC) AS rn
      FROM spreds s) t
JOIN clients c ON c.id = t.client_id
WHERE t.rn = 1 AND (c.is_active = true OR (c.is_active IS NULL AND c.status = 'active'))""",
    "fb_dedup": """
SELECT client_id, prediction_date, feedback_date, actually_churned
FROM (SELECT f.*, row_number() OVER (PARTITION BY client_id, prediction_date
                                     ORDER BY feedback_date DESC, actually_churned DESC) AS rn
      FROM feedback f) t WHERE rn = 1""",
    "runs": """
SELECT CAST(prediction_date AS DATE) AS run_day, model_version,
       count(*) AS total_predictions,
       count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS high_risk_count,
       count(*) FILTER (WHERE risk_level = 'medium') AS medium_risk_count,
       count(*) FILTER (WHERE risk_level = 'low') AS low_risk_count,
       min(prediction_date) AS start_time, max(prediction_date) AS end_time,
       CAST(floor((epoch_us(max(prediction_date)) - epoch_us(min(prediction_date))) / 1000000) AS BIGINT) AS duration_seconds
FROM spreds GROUP BY 1, 2""",
}

_DEPS = {
    "spreds": ["predictions"], "daily": ["spreds"], "latest_cp": ["spreds", "clients"],
    "fb_dedup": ["feedback"], "runs": ["spreds"],
}


def _order(names):
    out: list[str] = []

    def visit(n):
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with CTEs for the named views (dependencies first)."""
    extra = extra or {}
    ctes = []
    for n in _order(names):
        sql = VIEWS.get(n) or EXTRA.get(n)
        ctes.append(f"{n} AS ({sql.strip()})")
    for n, sql in extra.items():
        ctes.append(f"{n} AS ({sql.strip()})")
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


def with_recursive_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    s = with_views(body, *names, extra=extra)
    return "WITH RECURSIVE" + s[len("WITH"):]
