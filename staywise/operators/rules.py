"""Rule operators: a row in, an array of structs out.

Rules are Catalyst expressions: an array of ``when(condition, struct)``
in rule order, nulls filtered, optionally sorted by impact (rule order breaks
ties, so the sort is stable), then sliced.  No Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.risk import WIDE_BANDS, risk_level

IMPACT_RANK = {"high": 0, "medium": 1, "low": 2}

# Rule texts (factor, impact, description) as shown to users.
POOR_HEALTH = ("Poor Health Score", "high", "Client health is rated as fair or poor")
LOW_ACTIVITY = ("Low Recent Activity", "medium", "No activity in {} days")
NEW_CLIENT = ("New Client", "medium", "Client is in critical first 3 months")
LONG_TERM_AT_RISK = ("Long-term Client at Risk", "high", "Established client showing churn signals")
COMM_GAP = ("Communication Gap", None, "No communication in {} days")
MISSED_CHECKINS = ("Missed Check-ins", None, "Last official check-in was {} days ago")
HEALTH_DECLINING = ("Client Health Declining", None, "Recent health status was Fair or Poor")
NO_REPLACEMENT = ("No Replacement Requested", "high", "Client did not request team member replacement")
PERFORMANCE = ("Performance Issues", "medium", "Performance Improvement Plan was implemented")
NEW_EMPLOYEE = ("New Employee Period", "high", "First 90 days are a critical retention period")
LOW_ENGAGEMENT = ("Low Engagement", "medium", "No recent activity in {} days")
NO_CLIENT = ("No Client Assignment", "medium", "Team member not assigned to a client")
SIX_TO_TWELVE = ("6-12 Month Window", "medium", "Common attrition period for evaluating long-term fit")
REC_MEETING = ("Immediate 1:1 Meeting", "critical", "Schedule urgent conversation to understand concerns")
REC_ONBOARDING = ("Onboarding Check-in", "high", "Ensure smooth onboarding experience and address early concerns")
REC_ONBOARDING_SERVING = ("Onboarding Check-in", "high", "Ensure smooth onboarding experience")
REC_ASSIGNMENT = ("Client Assignment Review", "medium", "Consider assigning to an appropriate client project")
REC_CAREER = ("Career Development Discussion", "medium", "Discuss growth opportunities and career path")
REC_CAREER_SERVING = ("Career Development Discussion", "medium", "Discuss growth opportunities")
# Level -> recommended action (wide bands 75 / 50 / 25).
LEVEL_ACTIONS = {
    "critical": "Executive call within 48 hours",
    "high": "CSP outreach within 1 week",
    "medium": "Increase check-in frequency",
    "low": "Continue standard engagement",
}


def _num_text(template: str, value: Column) -> Column:
    head, tail = template.split("{}")
    return F.concat(F.lit(head), F.coalesce(value, F.lit(0)).cast("int").cast("string"), F.lit(tail))


def _item(rule: int, factor: str, impact, description, kind: str = "factor") -> Column:
    imp = impact if isinstance(impact, Column) else F.lit(impact)
    desc = description if isinstance(description, Column) else F.lit(description)
    key = "priority" if kind == "action" else "impact"
    return F.struct(F.lit(rule).alias("rule"), F.lit(factor).alias(kind), imp.alias(key), desc.alias("description"))


def _collect(items: list[tuple[Column, Column]], n: int) -> Column:
    """Items whose condition holds, in list order, first n.  ``array_compact``
    and ``slice`` are code-generated built-ins (no lambda functions)."""
    return F.slice(F.array_compact(F.array(*[F.when(cond, it) for cond, it in items])), 1, n)


def _by_impact(items: list[tuple[Column, Column, str, int]]) -> list[tuple[Column, Column]]:
    """Stable order by impact (high, medium, low), then rule order.  The
    impacts of the sorted variants are fixed per rule, so the order is decided
    when the plan is built instead of sorting every row's array."""
    ranked = sorted(items, key=lambda x: (IMPACT_RANK.get(x[2], 3), x[3]))
    return [(cond, it) for cond, it, _, _ in ranked]


def _get(df: DataFrame, name: str, default) -> Column:
    """``features.get(name, default)``: the column when present and not null."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def churn_factors(df: DataFrame, variant: str = "training", n: int = 3, p_col: str = "churn_probability",
                  out: str = "top_risk_factors") -> DataFrame:
    """I1 (training: four rules, sorted by impact) / I2 (serving: first three,
    unsorted).  Rules read the full feature row (trap T14)."""
    health, days = _get(df, "health_score", 3), _get(df, "days_since_activity", 0)
    tenure, p = _get(df, "tenure_months", 12), F.col(p_col)
    items = [
        (health <= 2, _item(1, *POOR_HEALTH), POOR_HEALTH[1], 1),
        (days > 30, _item(2, LOW_ACTIVITY[0], LOW_ACTIVITY[1], _num_text(LOW_ACTIVITY[2], days)), LOW_ACTIVITY[1], 2),
        (tenure < 3, _item(3, *NEW_CLIENT), NEW_CLIENT[1], 3),
    ]
    if variant == "training":
        items.append(((tenure > 24) & (p > 0.5), _item(4, *LONG_TERM_AT_RISK), LONG_TERM_AT_RISK[1], 4))
        return df.withColumn(out, _collect(_by_impact(items), n))
    return df.withColumn(out, _collect([(c, it) for c, it, _, _ in items], n))


def sync_factors(df: DataFrame, n: int = 5, out: str = "top_risk_factors") -> DataFrame:
    """Communication gap, missed check-ins, health, no replacement, PIP."""
    comm, chk = _get(df, "days_since_communication", 0), _get(df, "days_since_checkin", 0)
    health = _get(df, "health_score", 0)
    items = [
        (comm > 30, _item(1, COMM_GAP[0], F.when(comm > 60, "high").otherwise("medium"),
                          _num_text(COMM_GAP[2], comm))),
        (chk > 14, _item(2, MISSED_CHECKINS[0], F.when(chk > 30, "high").otherwise("medium"),
                         _num_text(MISSED_CHECKINS[2], chk))),
        (health <= 2, _item(3, HEALTH_DECLINING[0], F.when(health == 1, "high").otherwise("medium"),
                            HEALTH_DECLINING[2])),
        (_get(df, "no_replacement", 0) == 1, _item(4, *NO_REPLACEMENT)),
        (_get(df, "had_pip", 0) == 1, _item(5, *PERFORMANCE)),
    ]
    return df.withColumn(out, _collect(items, n))


def attrition_factors(df: DataFrame, variant: str = "training", n: int = 3,
                      out: str = "top_risk_factors") -> DataFrame:
    """New employee, low engagement, no client, and (training) the
    6-12 month window; training sorts by impact."""
    days = _get(df, "days_since_activity", 0)
    tenure = _get(df, "tenure_months", 12)
    items = [
        (_get(df, "is_new_employee", 0) == 1, _item(1, *NEW_EMPLOYEE), NEW_EMPLOYEE[1], 1),
        (days > 14, _item(2, LOW_ENGAGEMENT[0], LOW_ENGAGEMENT[1], _num_text(LOW_ENGAGEMENT[2], days)),
         LOW_ENGAGEMENT[1], 2),
        (_get(df, "has_client", 1) == 0, _item(3, *NO_CLIENT), NO_CLIENT[1], 3),
    ]
    if variant == "training":
        items.append(((tenure >= 6) & (tenure <= 12), _item(4, *SIX_TO_TWELVE), SIX_TO_TWELVE[1], 4))
        return df.withColumn(out, _collect(_by_impact(items), n))
    return df.withColumn(out, _collect([(c, it) for c, it, _, _ in items], n))


def recommendations(df: DataFrame, variant: str = "training", n: int = 3, p_col: str = "attrition_probability",
                    out: str = "recommended_actions") -> DataFrame:
    """First n of: p > 0.7 meeting, new employee onboarding, (training) no
    client review, p > 0.5 career talk."""
    p = F.col(p_col)
    onboarding = REC_ONBOARDING if variant == "training" else REC_ONBOARDING_SERVING
    career = REC_CAREER if variant == "training" else REC_CAREER_SERVING
    items = [(p > 0.7, _item(1, *REC_MEETING, kind="action")),
             (_get(df, "is_new_employee", 0) == 1, _item(2, *onboarding, kind="action"))]
    if variant == "training":
        items.append((_get(df, "has_client", 1) == 0, _item(3, *REC_ASSIGNMENT, kind="action")))
    items.append((p > 0.5, _item(4, *career, kind="action")))
    return df.withColumn(out, _collect(items, n))


def with_action(df: DataFrame, p_col: str = "churn_probability", bands=WIDE_BANDS) -> DataFrame:
    """I8: wide-band level and its recommended action."""
    lvl = risk_level(p_col, bands)
    action = None
    for k, v in LEVEL_ACTIONS.items():
        action = F.when(lvl == k, v) if action is None else action.when(lvl == k, v)
    return df.withColumn("action_level", lvl).withColumn("recommended_action", action)


def explode_items(df: DataFrame, key: str, col: str, kind: str = "factor") -> DataFrame:
    """Long form for reports and checks: one row per item with its position."""
    imp = "priority" if kind == "action" else "impact"
    return (df.select(key, F.posexplode(col).alias("pos", "it"))
            .select(key, "pos", F.col(f"it.{kind}").alias(kind), F.col(f"it.{imp}").alias(imp),
                    F.col("it.description").alias("description")))


# Importance-gated tests (feature, test, description template).
GATED_TESTS = (
    ("current_seat_count", lambda v: v < 3, "Low seat count ({}) indicates potential downsizing"),
    ("no_replacement", lambda v: v == 1, "Client not requesting TM replacement"),
    ("days_since_communication", lambda v: v > 30, "No communication in {} days"),
    ("days_since_checkin", lambda v: v > 21, "No check-in in {} days"),
    ("health_score", lambda v: v <= 2, "Low health score ({}/4)"),
    ("client_tenure_at_termination", lambda v: v < 180, "New client ({} days tenure)"),
)


def gated_factors(df: DataFrame, importance: DataFrame, n: int = 5, out: str = "top_risk_factors") -> DataFrame:
    """I4: only the n most important features are tested; each failing test
    gives (factor, importance in percent rounded 1, value, description).  The
    top-n importance rows (n rows) are read once and inlined as literals."""
    top = importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(n).collect()
    tests = {f: (t, d) for f, t, d in GATED_TESTS}
    items = []
    for r in top:
        f = r["feature"]
        if f not in tests:
            continue
        test, desc = tests[f]
        raw = _get(df, f, 0)          # printed in its own type: 2 for an integer, 2.0 for a double
        v = raw.cast("double")
        text = F.lit(desc) if "{}" not in desc else F.concat(F.lit(desc.split("{}")[0]), raw.cast("string"),
                                                             F.lit(desc.split("{}")[1]))
        item = F.struct(F.lit(f).alias("factor"), F.lit(round(r["importance"] * 100, 1)).alias("importance"),
                        v.alias("value"), text.alias("description"))
        items.append(F.when(test(v), item))
    arr = F.array_compact(F.array(*items)) if items else F.array()
    return df.withColumn(out, arr)


# The four features kept in a synced prediction document.
SYNC_FEATURE_KEYS = (("days_since_communication", "days_since_communication"),
                     ("days_since_checkin", "days_since_checkin"),
                     ("health_score", "health_score"), ("seat_count", "current_seat_count"))


def sync_records(df: DataFrame, model_version: str, as_of: str, model_name: str = "churn_gbt",
                 p_col: str = "churn_probability") -> DataFrame:
    """Prediction rows shaped for the store - level re-derived from the
    probability on the wide bands, integer score, the four-key feature
    document and the top-5 sync factors.  A dry run is this frame; a real
    sync hands it to ``DailyStore.upsert`` (batches become partitions)."""
    pairs = []
    for key, col in SYNC_FEATURE_KEYS:
        pairs += [F.lit(key), F.col(col).cast("double")]
    out = sync_factors(df, 5)
    return out.select(
        "client_id", "client_name", p_col,
        risk_level(p_col, WIDE_BANDS).alias("risk_level"),
        (F.col(p_col) * 100).cast("int").alias("risk_score"),
        F.to_timestamp_ntz(F.lit(as_of)).alias("prediction_date"),
        F.lit(model_version).alias("model_version"), F.lit(model_name).alias("model_name"),
        F.create_map(*pairs).alias("features"), "top_risk_factors")
