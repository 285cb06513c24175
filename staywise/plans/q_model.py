"""Registered model jobs (rows-only checks: their numbers come from fitted
models, so they are verified by invariants in tests/test_model.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from staywise.operators import features as FT
from staywise.operators import labels as LB
from staywise.operators import metrics as M
from staywise.operators import model as MO
from staywise.operators import rules as R
from staywise.plans.registry import query
from staywise.sources import adapters as A
from staywise.sources import ingest as I

_FITTED: dict[tuple, object] = {}


def churn_training(spark, sf):
    """The training matrix, materialised once: every fit iterates over it."""
    from staywise.session import materialize
    t = A.terminations(spark, sf)
    tm = FT.training_matrix(FT.training_data(t))
    return materialize(tm.withColumn("client_lost", F.col("client_lost").cast("int")))


def split(df, label):
    from staywise.session import evenly, materialize
    s = materialize(evenly(M.stratified_split(df, 0.8, label, "id", 42), df.count()))
    return s.filter(F.col("split") == "train").drop("split"), s.filter(F.col("split") == "test").drop("split")


#: Tables that the models are fitted on, and models kept.
_TABLES, _KEPT = ("customer", "lineitem", "nation", "orders", "supplier"), 8


def _fingerprint(spark, sf) -> str:
    """Names, sizes and times of the files that the models are fitted on."""
    files = None
    for t in _TABLES:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf.rstrip('/')}/{t}.parquet").select("path", "length", "modificationTime")
        files = part if files is None else files.unionByName(part)
    return str(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def _fitted(spark, sf, name, fit):
    """The model object of a fit on this data, kept for the session's other
    queries; data written anew are fitted anew."""
    key = (spark.sparkContext.applicationId, _fingerprint(spark, sf), name)
    if key not in _FITTED:
        while len(_FITTED) >= _KEPT:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[key] = fit()
    return _FITTED[key]


def churn_split(spark, sf):
    return split(churn_training(spark, sf), "client_lost")


def churn_model(spark, sf, train=None):
    """``train``: the training part, if the caller has it written already."""
    return _fitted(spark, sf, "churn", lambda: MO.fit_boosted(
        churn_split(spark, sf)[0] if train is None else train, FT.TRAINING_MATRIX_12, "client_lost"))


def calibrated_model(spark, sf, train=None):
    return _fitted(spark, sf, "calibrated", lambda: MO.calibrate(
        churn_split(spark, sf)[0] if train is None else train, FT.TRAINING_MATRIX_12, "client_lost", 5))


def scoring_rows(spark, sf):
    active = I.scan_clients(A.clients(spark, sf), active_only=True)
    return FT.scoring_matrix(active, FT.training_data(A.terminations(spark, sf)))


@query("boosted_fit")
def boosted_fit(spark, sf):
    """Fit on the training split, importances by feature."""
    return MO.feature_importances(spark, churn_model(spark, sf), FT.TRAINING_MATRIX_12)


@query("feature_importances")
def feature_importances(spark, sf):
    """the five most important features."""
    return boosted_fit(spark, sf).orderBy(F.col("importance").desc(), F.col("feature")).limit(5)


@query("evaluate_on_split")
def evaluate_on_split(spark, sf):
    """Held-out metrics at 0.5 plus exact AUC."""
    train, test = churn_split(spark, sf)
    m = churn_model(spark, sf, train)
    s = MO.positive_probability(m.transform(test.withColumn("client_lost", F.col("client_lost").cast("double"))))
    s = s.select("id", "p", F.col("client_lost").cast("int").alias("y"))
    return M._one_row_join(M.metrics_from_confusion(M.confusion(s, 0.5)), M.auc(s))


@query("calibrated_scores")
def calibrated_scores(spark, sf):
    """K6: five calibrated members, mean probability of every active client."""
    return MO.score(scoring_rows(spark, sf), calibrated_model(spark, sf), ["client_id", "client_name"])


@query("grid_search")
def grid_search(spark, sf):
    """K5: F0.5 of the positive class for each of the 162 combinations of the
    whole grid (5 folds; ``fits`` is the number of fits that this stands for)."""
    train, _ = churn_split(spark, sf)
    cvm = MO.grid_search(train, FT.TRAINING_MATRIX_12, "client_lost", k=5, parallelism=3)
    maps = cvm.getEstimatorParamMaps()
    rows = [(str({p.name: v for p, v in pm.items()}), float(mt), 5 * len(maps)) for pm, mt in zip(maps, cvm.avgMetrics)]
    return spark.createDataFrame(rows, "params string, f05 double, fits long")


@query("score_clients")
def score_clients(spark, sf):
    """Every active client's scoring row -> probability, score, level,
    factors and the features that were scored, one record each."""
    from staywise.functions.values import feature_map
    rows = scoring_rows(spark, sf)
    s = MO.score(rows, churn_model(spark, sf), ["client_id", "client_name", *FT.TRAINING_MATRIX_12])
    s = R.sync_factors(s.withColumn("features", feature_map(FT.TRAINING_MATRIX_12)), 5)
    return s.select("client_id", "client_name", "churn_probability", "risk_score", "risk_level", "top_risk_factors", "features")


def member_rows(spark, sf):
    """(features and label of every member with a tenure in range, features of
    the active ones to score, features of the active ones that cannot be scored:
    their tenure has no bucket)."""
    mf = FT.member_features(A.team_members(spark, sf), A.AS_OF_ACCOUNTS)
    lab = LB.label_member_attrition(A.team_members(spark, sf)).select("id", "left")
    status = A.team_members(spark, sf).select("id", "status")
    df = mf.join(lab, "id").join(status, "id")
    fit = df.filter(F.col("tenure_bucket").isNotNull())
    active = df.filter(F.lower("status") == "active").drop("status", "left")
    return (fit.drop("status"), active.filter(F.col("tenure_bucket").isNotNull()),
            active.filter(F.col("tenure_bucket").isNull()))


def member_model(spark, sf):
    def fit():
        from staywise.session import materialize
        w = materialize(MO.with_balanced_weights(member_rows(spark, sf)[0], "left"))
        return MO.fit_boosted(w, list(FT.MEMBER_FEATURES), "left", weight_col="weight")
    return _fitted(spark, sf, "members", fit)


def scored_members(spark, sf):
    """Every active member; those without a tenure bucket have no probability,
    score or level but a reason, and the factors and actions that need none."""
    from staywise.functions.risk import predicted_days
    _, rows, others = member_rows(spark, sf)
    s = MO.score(rows, member_model(spark, sf), ["id", *FT.MEMBER_FEATURES], "attrition_probability")
    s = s.withColumn("unscored_reason", F.lit(None).cast("string")).unionByName(
        others.select("id", *FT.MEMBER_FEATURES, F.lit("tenure outside the buckets").alias("unscored_reason")), allowMissingColumns=True)
    s = s.withColumn("predicted_days_to_attrition", predicted_days("attrition_probability"))
    return R.recommendations(R.attrition_factors(s, "training", 3), "training", 3)


@query("score_members")
def score_members(spark, sf):
    """Attrition model on member features with balanced weights; every
    active member's probability, score, level, predicted days, factors,
    recommendations and features, one record each (no probability, score, level
    and days, but a reason, where the tenure is outside the buckets)."""
    from staywise.functions.values import feature_map
    s = scored_members(spark, sf).withColumn("features", feature_map(FT.MEMBER_FEATURES))
    return s.select("id", "attrition_probability", "risk_score", "risk_level", "predicted_days_to_attrition",
                    "top_risk_factors", "recommended_actions", "features", "unscored_reason")


@query("member_recommendations")
def member_recommendations(spark, sf):
    """The recommended actions of every active member, a row each; an
    unscored member without any has one row with the reason."""
    s = scored_members(spark, sf).select("id", "unscored_reason", F.posexplode_outer("recommended_actions").alias("pos", "a"))
    s = s.filter(F.col("pos").isNotNull() | F.col("unscored_reason").isNotNull())
    return s.select("id", "pos", F.col("a.action").alias("action"), F.col("a.priority").alias("priority"), "unscored_reason")


@query("model_inspect")
def model_inspect(spark, sf):
    """K16."""
    return MO.inspect(spark, churn_model(spark, sf), FT.TRAINING_MATRIX_12)


def _explained(spark, sf):
    from staywise.operators.explain import explain
    return explain(spark, scoring_rows(spark, sf), churn_model(spark, sf), FT.TRAINING_MATRIX_12, key="client_id")


@query("explain_top3")
def explain_top3(spark, sf):
    """Three largest contributions for every active client."""
    from staywise.operators.explain import reason_text, top_contributions
    return reason_text(top_contributions(_explained(spark, sf), 3, "client_id"))


@query("global_importance")
def global_importance(spark, sf):
    """Mean absolute contribution per feature over all active clients."""
    from staywise.operators.explain import global_importance as gi
    return gi(_explained(spark, sf))


@query("gated_factors")
def gated_factors(spark, sf):
    """I4: importance-gated factors for every active client's scoring row."""
    m = churn_model(spark, sf)
    imp = MO.feature_importances(spark, m, FT.TRAINING_MATRIX_12)
    g = R.gated_factors(scoring_rows(spark, sf), imp, 5)
    return (g.select("client_id", F.posexplode("top_risk_factors").alias("pos", "f"))
            .select("client_id", "pos", "f.factor", "f.importance", "f.value", "f.description"))


@query("member_risk_summary")
def member_risk_summary(spark, sf):
    """Summary over the active members' attrition probabilities (one
    scoring run, so every member's latest row) and how many of the total have none."""
    from staywise.operators.summary import risk_summary
    return risk_summary(scored_members(spark, sf), "attrition_probability", prefix="members",
                        extra=[F.count("unscored_reason").alias("unscored_team_members")])


@query("weighted_fit")
def weighted_fit(spark, sf):
    """Imbalance handled by positive-class weights (scale_pos_weight),
    then held-out metrics of the weighted model."""
    train, test = churn_split(spark, sf)
    w = MO.with_scale_pos_weight(train, "client_lost")
    m = MO.fit_boosted(w, FT.TRAINING_MATRIX_12, "client_lost", weight_col="weight")
    s = MO.positive_probability(m.transform(test.withColumn("client_lost", F.col("client_lost").cast("double"))))
    s = s.select("id", "p", F.col("client_lost").cast("int").alias("y"))
    return M._one_row_join(M.metrics_from_confusion(M.confusion(s, 0.5)), M.auc(s))


@query("cross_val_scores")
def cross_val_scores(spark, sf):
    """Five folds of the churn matrix - per-fold AUC and F0.5 with the
    mean and population std across folds on every row."""
    from pyspark.sql import Window
    tm = churn_training(spark, sf)
    per = MO.cross_val_scores(tm, FT.TRAINING_MATRIX_12, "client_lost", 5)
    w = Window.partitionBy()  # five rows
    return per.select("fold", "auc_roc", "f05", F.avg("auc_roc").over(w).alias("mean_auc"),
                      F.stddev_pop("auc_roc").over(w).alias("std_auc"))
