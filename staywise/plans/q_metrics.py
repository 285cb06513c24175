"""Registered queries: metrics on fixed scores, splits, weights, model
comparison and rule outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from staywise.operators import features as FT
from staywise.operators import history as H
from staywise.operators import metrics as M
from staywise.operators import rules as R
from staywise.operators import summary as S
from staywise.plans.oracle_views import with_views
from staywise.plans.q_features import (AS_OF as ACC_AS_OF, CLIENT_FEATURES_SQL, FORM_FEATURES_SQL,
                                       MEMBER_FEATURES_SQL, TRAINING_DATA_SQL, TRAINING_MATRIX_SQL, _vocab_sql)
from staywise.plans.registry import query
from staywise.sources import adapters as A
from staywise.sources import ingest as I

GRID = M.THRESHOLD_GRID


def _f(beta2: float, p: str, r: str) -> str:
    return f"CASE WHEN {beta2} * {p} + {r} + 0.0 = 0 THEN 0.0 ELSE {1 + beta2} * {p} * {r} / ({beta2} * {p} + {r} + 0.0) END"


CONF_SQL = """
SELECT count(*) FILTER (WHERE p < 0.5 AND y <> 1) AS tn, count(*) FILTER (WHERE p >= 0.5 AND y <> 1) AS fp,
       count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp
FROM scored"""

COUNTS_SQL = """
SELECT p AS score, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
       CAST(sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM scored GROUP BY p"""

ABOVE_SQL = """
SELECT score, pos, neg,
       coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above,
       coalesce(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_above
FROM cnt"""

AUC_SQL = """
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0
            THEN sum(neg * (pos_above + pos / 2.0)) / (sum(pos) * sum(neg)) ELSE 0.5 END AS auc_roc FROM above"""

CURVE_SQL = """
SELECT score AS threshold, CAST(pos_above + pos AS BIGINT) AS tp, CAST(neg_above + neg AS BIGINT) AS fp,
       (pos_above + pos) / (pos_above + pos + neg_above + neg) AS precision,
       CASE WHEN (SELECT sum(pos) FROM cnt) > 0 THEN (pos_above + pos) / (SELECT sum(pos) FROM cnt) ELSE 0.0 END AS recall
FROM above"""

GRID_SQL = ("SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, CAST({t} AS DOUBLE))" for i, t in enumerate(GRID))
            + ") g(i, t)")

SWEEP_SQL = f"""
SELECT threshold, precision, recall, {_f(0.25, 'precision', 'recall')} AS f05, flagged, grid_index FROM (
  SELECT g.t AS threshold, CAST(g.i AS BIGINT) AS grid_index,
         count(s.id) AS flagged, count(s.id) FILTER (WHERE s.y = 1) AS tp,
         CASE WHEN count(s.id) > 0 THEN count(s.id) FILTER (WHERE s.y = 1) / count(s.id) ELSE 0.0 END AS precision,
         CASE WHEN (SELECT count(*) FROM scored WHERE y = 1) > 0
              THEN count(s.id) FILTER (WHERE s.y = 1) / (SELECT count(*) FROM scored WHERE y = 1) ELSE 0.0 END AS recall
  FROM grid g LEFT JOIN scored s ON s.p >= g.t GROUP BY g.t, g.i) x
WHERE flagged > 0"""


def _metric_views(body: str, *more: str, extra=None):
    ex = {"cnt": COUNTS_SQL, "above": ABOVE_SQL}
    ex.update(extra or {})
    return with_views(body, "scored", *more, extra=ex)


@query("confusion_matrix", with_views(f"""
SELECT tn, fp, fn, tp, CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0.0 END AS false_positive_rate
FROM ({CONF_SQL}) c""", "scored"))
def confusion_matrix(spark, sf):
    """D11 at threshold 0.5 on the fixed scores."""
    return M.confusion(A.scored(spark, sf), 0.5)


@query("auc_roc", _metric_views(AUC_SQL))
def auc_roc(spark, sf):
    """Exact AUC with half credit for ties."""
    return M.auc(A.scored(spark, sf))


@query("auc_from_summaries", _metric_views(AUC_SQL))
def auc_from_summaries(spark, sf):
    """D13 from stored daily counts: every scored row summarised on its day (a
    third of the days twice), the AUC over all days from the summaries."""
    from staywise.operators.summaries import ScoreSummaries
    from staywise.plans.q_io import _store_folder
    days = A.predictions(spark, sf).select("id", F.to_date("prediction_date").alias("day"))
    rows = A.scored(spark, sf).join(days, "id")
    s = ScoreSummaries(spark, _store_folder(spark, "summaries"))
    for k in (0, 1, 2, 1):
        s.add(rows.where(F.pmod(F.dayofyear("day"), F.lit(3)) == k))
    return s.auc()


@query("binary_metrics", _metric_views(f"""
SELECT tn, fp, fn, tp, false_positive_rate, accuracy, precision, recall,
       {_f(1.0, 'precision', 'recall')} AS f1, {_f(0.25, 'precision', 'recall')} AS f05, a.auc_roc
FROM (SELECT c.*, CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0.0 END AS false_positive_rate,
             CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END AS accuracy,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
      FROM ({CONF_SQL}) c) m, ({AUC_SQL}) a"""))
def binary_metrics(spark, sf):
    """Accuracy, precision, recall, F1, F0.5 (0 on zero division) and AUC."""
    s = A.scored(spark, sf)
    return M._one_row_join(M.metrics_from_confusion(M.confusion(s, 0.5)), M.auc(s))


@query("pr_curve", _metric_views(CURVE_SQL))
def pr_curve(spark, sf):
    """Precision / recall at every distinct score."""
    return M.pr_curve(A.scored(spark, sf))


@query("threshold_sweep", with_views(SWEEP_SQL, "scored", extra={"grid": GRID_SQL}))
def threshold_sweep(spark, sf):
    """D15 over the fixed grid."""
    return M.threshold_sweep(A.scored(spark, sf), GRID)


@query("best_threshold", with_views(f"""
SELECT coalesce((SELECT threshold FROM sw WHERE f05 > 0 ORDER BY f05 DESC, grid_index ASC LIMIT 1), 0.5) AS threshold,
       coalesce((SELECT max(f05) FROM sw WHERE f05 > 0), 0.0) AS f05""", "scored",
                                   extra={"grid": GRID_SQL, "sw": SWEEP_SQL}))
def best_threshold(spark, sf):
    """K7: first strictly-better F0.5 on the grid, starting from 0.5."""
    return M.best_threshold_grid(M.threshold_sweep(A.scored(spark, sf), GRID))


@query("best_threshold_curve", _metric_views(f"""
SELECT threshold, precision, recall, f05 FROM (
  SELECT threshold, precision, recall,
         (1 + 0.25) * (precision * recall) / ((0.25 * precision) + recall + 1e-8) AS f05 FROM curve) x
ORDER BY f05 DESC, threshold ASC LIMIT 1""", extra={"curve": CURVE_SQL}))
def best_threshold_curve(spark, sf):
    """K8: argmax of F0.5 over the PR curve."""
    return M.best_threshold_curve(M.pr_curve(A.scored(spark, sf)))


@query("class_weights", with_views("""
SELECT label, n_label, n / (k * n_label) AS weight, neg / greatest(pos, 1) AS scale_pos_weight FROM (
  SELECT y AS label, count(*) AS n_label, sum(count(*)) OVER () AS n, count(*) OVER () AS k,
         sum(CASE WHEN y = 1 THEN count(*) ELSE 0 END) OVER () AS pos,
         sum(CASE WHEN y = 1 THEN 0 ELSE count(*) END) OVER () AS neg
  FROM scored GROUP BY y) t""", "scored"))
def class_weights(spark, sf):
    """D20/K11."""
    return M.class_weights(A.scored(spark, sf))


@query("label_balance", with_views("""
SELECT count(*) AS samples, count(*) FILTER (WHERE churned = 1) AS positives,
       CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE churned = 1) / count(*) ELSE 0.0 END AS positive_rate
FROM (SELECT CASE WHEN client_lost = 'Yes' THEN 1 WHEN client_lost = 'No' THEN 0 END AS churned FROM terminations) t
WHERE churned IS NOT NULL""", "terminations"))
def label_balance(spark, sf):
    """D23 over the labelled termination rows."""
    return M.label_balance(I.load_labeled(A.terminations(spark, sf)), "churned")


SPLIT_RANK = """
SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) - 1 AS pos,
       count(*) OVER (PARTITION BY y) AS n FROM scored"""


@query("stratified_split", with_views("""
SELECT id, y, CASE WHEN pos < round(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM rk""", "scored",
                                      extra={"rk": SPLIT_RANK}))
def stratified_split(spark, sf):
    """K1: exact 80/20 per label by seeded hash order."""
    return M.stratified_split(A.scored(spark, sf), 0.8, "y", "id", 42).select("id", "y", "split")


@query("stratified_folds", with_views("SELECT id, y, CAST(pos % 5 AS BIGINT) AS fold FROM rk", "scored",
                                      extra={"rk": SPLIT_RANK}))
def stratified_folds(spark, sf):
    """K2: five folds, balanced per label."""
    return M.stratified_folds(A.scored(spark, sf), 5, "y", "id", 42).select("id", "y", "fold")


@query("cv_summary", with_views("""
SELECT round(avg(auc_roc), 6) AS mean_auc, round(stddev_pop(auc_roc), 6) AS std_auc, count(*) AS folds FROM (
  SELECT fold, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                    THEN sum(neg * (pos_above + pos / 2.0)) / (sum(pos) * sum(neg)) ELSE 0.5 END AS auc_roc
  FROM (SELECT fold, score, pos, neg,
               coalesce(sum(pos) OVER (PARTITION BY fold ORDER BY score DESC
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above
        FROM (SELECT pos % 5 AS fold, s.p AS score, sum(CASE WHEN s.y = 1 THEN 1 ELSE 0 END) AS pos,
                     sum(CASE WHEN s.y = 1 THEN 0 ELSE 1 END) AS neg
              FROM rk JOIN scored s ON s.id = rk.id GROUP BY 1, 2) c) a
  GROUP BY fold) f""", "scored", extra={"rk": SPLIT_RANK}))
def cv_summary(spark, sf):
    """Mean and population std of the per-fold AUC (folds of K2)."""
    s = M.stratified_folds(A.scored(spark, sf), 5, "y", "id", 42)
    per = M.auc(s, by=["fold"])
    return per.agg(F.round(F.avg("auc_roc"), 6).alias("mean_auc"),
                   F.round(F.stddev_pop("auc_roc"), 6).alias("std_auc"), F.count(F.lit(1)).alias("folds"))


def _std_sql() -> str:
    cols = FT.TRAINING_MATRIX_12
    sel = ", ".join(f"coalesce(round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / "
                    f"nullif(stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0), 6), 0.0) AS {c}" for c in cols)
    return f"SELECT id, {sel} FROM tm"


TM_EXTRA = {"ff": FORM_FEATURES_SQL, "td": TRAINING_DATA_SQL,
            "vg": _vocab_sql("td", "geo_location", "Unknown"), "tm": TRAINING_MATRIX_SQL}


@query("standardize", with_views(_std_sql(), "terminations", extra=TM_EXTRA))
def standardize(spark, sf):
    """K3: population-std scaling of the 12 training features."""
    t = A.terminations(spark, sf)
    tm = FT.training_matrix(FT.training_data(t))
    return M.standardize(tm, FT.TRAINING_MATRIX_12, ("id",), 6)


def _describe_sql() -> str:
    parts = []
    for c in FT.TRAINING_MATRIX_12:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS feature, count({v}) AS count, round(avg({v}), 2) AS mean,
       round(stddev_samp({v}), 2) AS std, round(min({v}), 2) AS min, round(quantile_cont({v}, 0.25), 2) AS p25,
       round(quantile_cont({v}, 0.5), 2) AS p50, round(quantile_cont({v}, 0.75), 2) AS p75, round(max({v}), 2) AS max
FROM tm""")
    return "\nUNION ALL\n".join(parts)


@query("describe_features", with_views(_describe_sql(), "terminations", extra=TM_EXTRA))
def describe_features(spark, sf):
    """D16 over the 12-column training matrix."""
    t = A.terminations(spark, sf)
    return M.describe(FT.training_matrix(FT.training_data(t)), FT.TRAINING_MATRIX_12)


@query("compare_models", with_views("""
SELECT metric, round(v1, 6) AS v1, round(v2, 6) AS v2, round(v2 - v1, 6) AS difference,
       CASE WHEN round(v2 - v1, 6) > 0 THEN 'improved' WHEN round(v2 - v1, 6) < 0 THEN 'worse' ELSE 'same' END AS direction
FROM (
  SELECT metric, max(CASE WHEN model_version = 'v1' THEN value END) AS v1,
         max(CASE WHEN model_version = 'v2' THEN value END) AS v2
  FROM (
    SELECT model_version, 'precision' AS metric, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS value FROM cm
    UNION ALL SELECT model_version, 'recall', CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END FROM cm
    UNION ALL SELECT model_version, 'accuracy', CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn)
                                                     ELSE 0.0 END FROM cm) l
  GROUP BY metric) w""", "spreds", "fb_dedup", extra={"cm": """
SELECT p.model_version,
       count(*) FILTER (WHERE p.churn_probability < 0.5 AND NOT f.actually_churned) AS tn,
       count(*) FILTER (WHERE p.churn_probability >= 0.5 AND NOT f.actually_churned) AS fp,
       count(*) FILTER (WHERE p.churn_probability < 0.5 AND f.actually_churned) AS fn,
       count(*) FILTER (WHERE p.churn_probability >= 0.5 AND f.actually_churned) AS tp
FROM spreds p JOIN fb_dedup f ON f.client_id = p.client_id AND f.prediction_date = CAST(p.prediction_date AS DATE)
GROUP BY p.model_version"""}))
def compare_models(spark, sf):
    """Precision / recall / accuracy of each model version against the
    recorded outcomes (feedback of the same client and day), side by side."""
    p = H.with_day(H.score_levels(A.predictions(spark, sf)))
    fb = S.feedback_dedup(A.feedback(spark, sf)).select(
        "client_id", F.col("prediction_date").alias("prediction_day"),
        F.col("actually_churned").cast("int").alias("y"))
    j = p.join(fb, ["client_id", "prediction_day"], "inner")
    m = M.metrics_from_confusion(M.confusion(j, 0.5, "y", "churn_probability", by=["model_version"]))
    long = m.select("model_version", F.explode(F.array(
        F.struct(F.lit("precision").alias("metric"), F.col("precision").alias("value")),
        F.struct(F.lit("recall").alias("metric"), F.col("recall").alias("value")),
        F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")))).alias("x")).select(
        "model_version", "x.*")
    w = long.groupBy("metric").pivot("model_version", ["v1", "v2"]).agg(F.max("value"))
    d = F.round(F.col("v2") - F.col("v1"), 6)
    return w.select("metric", F.round("v1", 6).alias("v1"), F.round("v2", 6).alias("v2"), d.alias("difference"),
                    F.when(d > 0, "improved").when(d < 0, "worse").otherwise("same").alias("direction"))


# ---- rules -------------------------------------------------------------

def _client_rule_base(spark, sf):
    from staywise.plans.q_history import latest_cp
    lat = latest_cp(spark, sf).select("client_id", "churn_probability")
    feats = FT.client_features(A.clients(spark, sf), ACC_AS_OF).withColumnRenamed("id", "client_id")
    return lat.join(feats, "client_id", "inner")


def _rank_sql(src: str, key: str, rules: list[tuple[str, str, str, str]], n: int, sort: bool) -> str:
    parts = [f"SELECT {key}, {i + 1} AS rule, '{f}' AS factor, {imp} AS impact, {desc} AS description "
             f"FROM {src} WHERE {cond}" for i, (cond, f, imp, desc) in enumerate(rules)]
    order = ("CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, rule"
             if sort else "rule")
    return f"""
SELECT {key}, CAST(pos - 1 AS BIGINT) AS pos, factor, impact, description FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS pos FROM (
  {' UNION ALL '.join(parts)}) u) r WHERE pos <= {n}"""


CLIENT_BASE_SQL = f"""
SELECT l.client_id, l.churn_probability, f.* EXCLUDE (id) FROM latest_cp l JOIN cf f ON f.id = l.client_id"""


def _txt(template: str, col: str) -> str:
    head, tail = template.split("{}")
    return f"'{head}' || CAST(CAST(trunc(coalesce({col}, 0)) AS BIGINT) AS VARCHAR) || '{tail}'"


CHURN_RULES = [
    ("health_score <= 2", R.POOR_HEALTH[0], "'high'", f"'{R.POOR_HEALTH[2]}'"),
    ("days_since_activity > 30", R.LOW_ACTIVITY[0], "'medium'", _txt(R.LOW_ACTIVITY[2], "days_since_activity")),
    ("tenure_months < 3", R.NEW_CLIENT[0], "'medium'", f"'{R.NEW_CLIENT[2]}'"),
]
CHURN_RULE_4 = ("tenure_months > 24 AND churn_probability > 0.5", R.LONG_TERM_AT_RISK[0], "'high'",
                f"'{R.LONG_TERM_AT_RISK[2]}'")
CF_EXTRA = {"vi": _vocab_sql("clients", "industry_type", "OTHER"),
            "vl": _vocab_sql("clients", "client_location", "Unknown"), "cf": CLIENT_FEATURES_SQL}


@query("churn_factors", with_views(_rank_sql("base", "client_id", CHURN_RULES + [CHURN_RULE_4], 3, True),
                                   "latest_cp", extra={**CF_EXTRA, "base": CLIENT_BASE_SQL}))
def churn_factors(spark, sf):
    """I1 (training variant) for every active client's latest prediction."""
    df = R.churn_factors(_client_rule_base(spark, sf), "training", 3)
    return R.explode_items(df, "client_id", "top_risk_factors")


@query("serving_churn_factors", with_views(_rank_sql("base", "client_id", CHURN_RULES, 3, False),
                                           "latest_cp", extra={**CF_EXTRA, "base": CLIENT_BASE_SQL}))
def serving_churn_factors(spark, sf):
    """I2 (serving variant)."""
    df = R.churn_factors(_client_rule_base(spark, sf), "serving", 3)
    return R.explode_items(df, "client_id", "top_risk_factors")


SYNC_RULES = [
    ("days_since_communication > 30", R.COMM_GAP[0],
     "CASE WHEN days_since_communication > 60 THEN 'high' ELSE 'medium' END",
     _txt(R.COMM_GAP[2], "days_since_communication")),
    ("days_since_checkin > 14", R.MISSED_CHECKINS[0],
     "CASE WHEN days_since_checkin > 30 THEN 'high' ELSE 'medium' END",
     _txt(R.MISSED_CHECKINS[2], "days_since_checkin")),
    ("health_score <= 2", R.HEALTH_DECLINING[0], "CASE WHEN health_score = 1 THEN 'high' ELSE 'medium' END",
     f"'{R.HEALTH_DECLINING[2]}'"),
    ("no_replacement = 1", R.NO_REPLACEMENT[0], "'high'", f"'{R.NO_REPLACEMENT[2]}'"),
    ("had_pip = 1", R.PERFORMANCE[0], "'medium'", f"'{R.PERFORMANCE[2]}'"),
]


@query("sync_factors", with_views(_rank_sql("td", "id", SYNC_RULES, 5, False), "terminations",
                                  extra={"ff": FORM_FEATURES_SQL, "td": TRAINING_DATA_SQL}))
def sync_factors(spark, sf):
    """I3 over every termination row with features."""
    t = A.terminations(spark, sf)
    df = R.sync_factors(FT.training_data(t), 5)
    return R.explode_items(df, "id", "top_risk_factors")


ATTR_RULES = [
    ("is_new_employee = 1", R.NEW_EMPLOYEE[0], "'high'", f"'{R.NEW_EMPLOYEE[2]}'"),
    ("days_since_activity > 14", R.LOW_ENGAGEMENT[0], "'medium'", _txt(R.LOW_ENGAGEMENT[2], "days_since_activity")),
    ("has_client = 0", R.NO_CLIENT[0], "'medium'", f"'{R.NO_CLIENT[2]}'"),
    ("tenure_months >= 6 AND tenure_months <= 12", R.SIX_TO_TWELVE[0], "'medium'", f"'{R.SIX_TO_TWELVE[2]}'"),
]


@query("attrition_factors", with_views(_rank_sql("mf", "id", ATTR_RULES, 3, True), "team_members",
                                       extra={"vr": _vocab_sql("team_members", "role", "team_member"),
                                              "mf": MEMBER_FEATURES_SQL}))
def attrition_factors(spark, sf):
    """I5 (training variant) over every member."""
    df = R.attrition_factors(FT.member_features(A.team_members(spark, sf), ACC_AS_OF), "training", 3)
    return R.explode_items(df, "id", "top_risk_factors")


@query("level_action", with_views("""
SELECT client_id, churn_probability,
       CASE WHEN churn_probability >= 0.75 THEN 'critical' WHEN churn_probability >= 0.5 THEN 'high'
            WHEN churn_probability >= 0.25 THEN 'medium' ELSE 'low' END AS action_level,
       CASE WHEN churn_probability >= 0.75 THEN 'Executive call within 48 hours'
            WHEN churn_probability >= 0.5 THEN 'CSP outreach within 1 week'
            WHEN churn_probability >= 0.25 THEN 'Increase check-in frequency'
            ELSE 'Continue standard engagement' END AS recommended_action
FROM latest_cp""", "latest_cp"))
def level_action(spark, sf):
    """I8 on every active client's latest prediction."""
    from staywise.plans.q_history import latest_cp
    return R.with_action(latest_cp(spark, sf)).select("client_id", "churn_probability", "action_level",
                                                     "recommended_action")
