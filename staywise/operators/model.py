"""Model operators on ``pyspark.ml``.

Fitting is data-parallel (GBT builds each tree from per-partition
histograms); scoring is a ``transform`` - one projection per partition, no
Python workers.  Probabilities leave the vector type through
``vector_to_array`` so the risk Columns stay codegen'd.
"""

from __future__ import annotations

import json
import statistics
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staywise.functions.risk import STRICT_BANDS, risk_level, risk_score
from staywise.operators import gradient
from staywise.operators.metrics import stratified_folds
from staywise.session import EVEN_ROWS, evenly, materialize

# Default boosted-tree settings (depth 4, 100 trees, rate 0.1).
DEFAULT_PARAMS = {"maxDepth": 4, "maxIter": 100, "stepSize": 0.1, "subsamplingRate": 0.8,
                  "minInstancesPerNode": 1, "seed": 42}

#: Rows a core holds while models are fitted side by side: a fit keeps each of
#: its rows in memory (about 200 bytes), so more rows mean fewer fits at once.
ROWS_PER_CORE = 3_000_000

# The searched grid, by the settings that boosted trees have here
# (depth, rows a leaf must hold, trees, least gain of a split, rate): 162 combinations.
FULL_GRID = {"maxDepth": (2, 3, 4), "minInstancesPerNode": (3, 5, 7), "maxIter": (100, 150, 200),
             "minInfoGain": (0.1, 0.3, 0.5), "stepSize": (0.05, 0.1)}


def fit_guard(df: DataFrame, label: str) -> dict:
    """Refuse to fit on no rows or one class; warn under 10 rows or
    fewer than 5 positives.  One aggregation."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")).first()
    n, pos = r["n"], r["pos"]
    if n == 0:
        raise ValueError("no training rows")
    if pos == 0 or pos == n:
        raise ValueError("only one class in the training rows")
    warnings = []
    if n < 10:
        warnings.append(f"only {n} training rows")
    if pos < 5:
        warnings.append(f"only {pos} positive rows")
    return {"rows": n, "positives": pos, "warnings": warnings}


def _pipeline(features: Sequence[str], label: str, params: Mapping, weight_col: str | None,
              scale: bool) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep")]
    fcol = "raw_features"
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
        fcol = "features"
    gbt = GBTClassifier(featuresCol=fcol, labelCol=label, **dict(params))
    if weight_col:
        gbt.setWeightCol(weight_col)
    stages.append(gbt)
    return Pipeline(stages=stages)


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None,
                weight_col: str | None = None, scale: bool = True) -> PipelineModel:
    """K4: binary boosted trees.  Parameters without a Spark equal (L1/L2
    leaf penalties, column subsampling) are not faked."""
    p = {**DEFAULT_PARAMS, **(params or {})}
    data = df.withColumn(label, F.col(label).cast("double"))
    return _pipeline(features, label, p, weight_col, scale).fit(data)


def with_balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """N / (k * n_class) per row; per-label weights are a table of one
    row per label value (windows over it give n and k), joined back."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()
    weights = per.select(label, (F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc"))).alias(out))
    return df.join(weights, label)


def positive_probability(pred: DataFrame, prob_col: str = "probability", out: str = "p") -> DataFrame:
    return pred.withColumn(out, vector_to_array(F.col(prob_col)).getItem(1))


def margin(pred: DataFrame, raw_col: str = "rawPrediction", out: str = "margin") -> DataFrame:
    """GBT raw prediction is (-m, m); the margin of the positive class is m."""
    return pred.withColumn(out, vector_to_array(F.col(raw_col)).getItem(1))


@dataclass
class CalibratedModel:
    """K6: k (tree model, sigmoid) pairs; probability = mean of the k
    calibrated probabilities (the base model is not used for them)."""
    members: list = field(default_factory=list)  # (PipelineModel, a, b)

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        cols = []
        d = df
        for i, (m, a, b) in enumerate(self.members):
            scored = m.transform(d)
            d = margin(scored, out=f"_m{i}").drop("raw_features", "features", "rawPrediction", "probability",
                                                    "prediction")
            cols.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col(f"_m{i}") + F.lit(b)))))
        mean = sum(cols[1:], cols[0]) / len(cols)
        return d.withColumn(out, mean).drop(*[f"_m{i}" for i in range(len(self.members))])


def _platt(scores: DataFrame, label: str):
    """Sigmoid fit on one feature with Platt's smoothed targets
    t+ = (N+ + 1) / (N+ + 2) and t- = 1 / (N- + 2): each example becomes two
    weighted rows (label 1 with weight t, label 0 with weight 1 - t).  The
    two class counts are one aggregate row."""
    c = scores.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).first()
    t_pos, t_neg = (c["p"] + 1.0) / (c["p"] + 2.0), 1.0 / (c["n"] + 2.0)
    t = F.when(F.col(label) == 1, F.lit(t_pos)).otherwise(F.lit(t_neg))
    rows = scores.select("margin", F.explode(F.array(
        F.struct(F.lit(1.0).alias("target"), t.alias("w")),
        F.struct(F.lit(0.0).alias("target"), (1 - t).alias("w")))).alias("r")).select("margin", "r.*")
    va = VectorAssembler(inputCols=["margin"], outputCol="_mv")
    lr = LogisticRegression(featuresCol="_mv", labelCol="target", weightCol="w", regParam=0.0,
                            standardization=False, maxIter=100)
    return lr.fit(va.transform(rows))


def calibrate(df: DataFrame, features: Sequence[str], label: str, k: int = 5, params: Mapping | None = None,
              key: str = "id", seed: int = 42) -> CalibratedModel:
    """K6: for each of k stratified folds, fit on the other folds and fit a
    one-feature logistic regression (Platt) on the held-out margins."""
    folded, rows = _folded(df, features, label, k, key, seed)
    at_once = _at_once(df.sparkSession, rows, k)
    models = _fold_models(folded, rows, features, label, k, params, at_once)

    def member(i: int):
        held = folded.filter(F.col("fold") == i).withColumn(label, F.col(label).cast("double"))
        lrm = _platt(margin(models[i].transform(held)).select("margin", label), label)
        return models[i], float(lrm.coefficients[0]), float(lrm.intercept)
    return CalibratedModel(_side_by_side(member, k, at_once))


def _fold_models(folded: DataFrame, rows: int, features: Sequence[str], label: str, k: int, params: Mapping | None, at_once: int) -> list[PipelineModel]:
    """For each fold the boosted model of the rows outside it.  Under ``EVEN_ROWS``
    rows the library fits them itself; above, they grow side by side (``gradient``):
    the same but for rounding, which decides between splits of equal gain."""
    data = folded.withColumn(label, F.col(label).cast("double"))
    if rows < EVEN_ROWS:
        return _side_by_side(lambda i: fit_boosted(data.filter(F.col("fold") != i), features, label, params), k, at_once)
    pipe = _pipeline(features, label, {**DEFAULT_PARAMS, **(params or {})}, None, True)
    return gradient.fit([gradient.Part(data.filter(F.col("fold") != i)) for i in range(k)], features, label, pipe, at_once)


def _folded(df: DataFrame, features: Sequence[str], label: str, k: int, key: str, seed: int) -> tuple[DataFrame, int]:
    """(the columns of a fit with their fold, dealt evenly; their number)."""
    rows = df.select(*dict.fromkeys([key, label, *features]))
    n = rows.count()
    return materialize(evenly(stratified_folds(rows, k, label, key, seed), n)), n


def _at_once(spark: SparkSession, rows: int, most: int) -> int:
    """How many fits over ``rows`` rows the cluster's memory holds side by side."""
    return max(1, min(most, ROWS_PER_CORE * spark.sparkContext.defaultParallelism // max(1, rows)))


def _side_by_side(fit, k: int, at_once: int) -> list:
    """The k independent fits as concurrent Spark jobs, ``at_once`` at a time, in order."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(inheritable_thread_target(fit), range(k)))


def grid_search(df: DataFrame, features: Sequence[str], label: str, grid: Mapping[str, Sequence] | None = None,
                k: int = 5, key: str = "id", seed: int = 42, parallelism: int = 2):
    """K5: cross-validated search maximising F0.5 of the positive class, folds
    fixed by K2.  ``grid`` (parameter -> values) decides the number of
    combinations, the product of its sizes, each fitted on k folds;
    ``FULL_GRID`` is the whole search.  What the grid does not name stays at the
    defaults.  All fits grow side by side (``gradient``); the best combination
    is fitted on all rows, as ``CrossValidator`` does."""
    grid = FULL_GRID if grid is None else grid
    folded, rows = _folded(df, features, label, k, key, seed)
    pipe = _pipeline(features, label, DEFAULT_PARAMS, None, True)
    gbt = pipe.getStages()[-1]
    pg = ParamGridBuilder()
    for name, values in grid.items():
        pg = pg.addGrid(gbt.getParam(name), list(values))
    maps = pg.build()
    data = folded.withColumn(label, F.col(label).cast("double"))
    parts = [gradient.Part(data.filter(F.col("fold") != i), data.filter(F.col("fold") == i)) for i in range(k)]
    found = gradient.tallies(parts, features, label, pipe, [{p.name: v for p, v in m.items()} for m in maps], _at_once(df.sparkSession, rows, parallelism))
    scores = [[_f05(*x) for x in folds] for folds in found]
    means = [sum(x) / k for x in scores]
    best = max(range(len(maps)), key=means.__getitem__)
    model = pipe.copy(maps[best]).fit(data)
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", beta=0.5, metricLabel=1.0)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, numFolds=k, foldCol="fold", seed=seed)
    return cv._copyValues(CrossValidatorModel(model, means, None, [statistics.pstdev(x) for x in scores]))


def _f05(tp: int, fp: int, fn: int) -> float:
    """F0.5 of the positive class; 0 where nothing is found."""
    p, r = tp / (tp + fp) if tp else 0.0, tp / (tp + fn) if tp else 0.0
    return 1.25 * p * r / (0.25 * p + r) if tp else 0.0


def score(df: DataFrame, model, keep: Sequence[str], p_out: str = "churn_probability",
          bands=STRICT_BANDS) -> DataFrame:
    """Probability, score and level for every row (PipelineModel or
    CalibratedModel)."""
    if isinstance(model, CalibratedModel):
        s = model.transform(df, out=p_out)
    else:
        s = positive_probability(model.transform(df), out=p_out)
    return s.select(*keep, p_out, risk_score(p_out).alias("risk_score"), risk_level(p_out, bands).alias("risk_level"))


def feature_importances(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Named importances, descending (one row per feature)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda x: -x[1])
    return spark.createDataFrame(rows, "feature string, importance double")


def inspect(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Parameters, tree count, scaler mean/std, as (section, name, value) rows."""
    rows = []
    gbt = model.stages[-1]
    for p, v in gbt.extractParamMap().items():
        rows.append(("param", p.name, str(v)))
    rows.append(("trees", "count", str(gbt.getNumTrees)))
    rows.append(("trees", "total_nodes", str(gbt.totalNumNodes)))
    if len(model.stages) == 3:
        sc = model.stages[1]
        for f, m, s in zip(features, sc.mean.toArray(), sc.std.toArray()):
            rows.append(("scaler_mean", f, repr(float(m))))
            rows.append(("scaler_std", f, repr(float(s))))
    return spark.createDataFrame(rows, "section string, name string, value string")


def save(model: PipelineModel | CalibratedModel, meta: Mapping, root: str, version: str,
         vocabularies: Mapping[str, DataFrame] | None = None) -> str:
    """A model bundle in a folder of its own: the model (each member of a
    calibrated one), its vocabularies (tables of value and code) and one
    metadata document with the sequence number of the save, which decides
    ``latest``.  The document is written last, so a bundle without it was never
    finished and is not seen.  One writer at a time per root."""
    spark = SparkSession.getActiveSession()
    path = f"{root.rstrip('/')}/{version}"
    members = model.members if isinstance(model, CalibratedModel) else [(model, None, None)]
    for i, (m, _, _) in enumerate(members):
        m.write().overwrite().save(f"{path}/model/{i}")
    for name, v in (vocabularies or {}).items():
        v.write.mode("overwrite").parquet(f"{path}/vocabulary/{name}")
    known = _metas(spark, root)
    last = None if known is None else known.agg(F.max("sequence")).first()[0]
    doc = {**dict(meta), "calibrated": isinstance(model, CalibratedModel), "sigmoids": [(a, b) for _, a, b in members],
           "vocabularies": sorted(vocabularies or {})}
    row = (version, 0 if last is None else last + 1, json.dumps(doc, default=str))
    spark.createDataFrame([row], _META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return path


_META = "version string, sequence long, meta string"


def _metas(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_META).json(f"{root.rstrip('/')}/*/meta")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load(root: str, version: str = "latest"):
    """(model, metadata, version) of a bundle; versions are listed through
    Spark's file source, so the registry works on any Hadoop-compatible store.
    ``latest`` is the one saved last, whatever its name."""
    spark = SparkSession.getActiveSession()
    metas = _metas(spark, root)
    if metas is not None:
        metas = metas.filter(F.col("version") == version) if version != "latest" else metas
        row = metas.agg(F.max_by(F.struct("version", "meta"), "sequence").alias("r")).first()["r"]
    if metas is None or row is None:
        raise FileNotFoundError(f"no model {version} under {root}")
    meta = json.loads(row["meta"])
    path = f"{root.rstrip('/')}/{row['version']}"
    members = [(PipelineModel.load(f"{path}/model/{i}"), a, b) for i, (a, b) in enumerate(meta["sigmoids"])]
    return CalibratedModel(members) if meta["calibrated"] else members[0][0], meta, row["version"]


def load_vocabulary(root: str, version: str, name: str) -> DataFrame:
    return SparkSession.getActiveSession().read.parquet(f"{root.rstrip('/')}/{version}/vocabulary/{name}")


def with_scale_pos_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """K10 fallback (the reference's own path when the oversampling library
    is not installed, as here): positives weighted by neg / max(pos, 1),
    negatives by 1.  Per-label weights are a table of one row per label
    value, sent to every task: joined by the label, half of all rows would meet
    in one."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy()
    pos = F.sum(F.when(F.col(label) == 1, F.col("_n")).otherwise(0)).over(w)
    neg = F.sum(F.when(F.col(label) == 1, 0).otherwise(F.col("_n"))).over(w)
    weights = per.select(label, F.when(F.col(label) == 1, neg / F.greatest(pos, F.lit(1)))
                         .otherwise(F.lit(1.0)).alias(out))
    return df.join(F.broadcast(weights), label)


def cross_val_scores(df: DataFrame, features: Sequence[str], label: str, k: int = 5,
                     params: Mapping | None = None, key: str = "id", seed: int = 42) -> DataFrame:
    """K9: for each of k stratified folds, fit on the others and score the
    held-out fold; exact AUC and F0.5 at 0.5 per fold (one row per fold)."""
    from staywise.operators.metrics import auc, confusion, metrics_from_confusion
    folded, rows = _folded(df, features, label, k, key, seed)
    scored = None
    for i, m in enumerate(_fold_models(folded, rows, features, label, k, params, _at_once(df.sparkSession, rows, k))):
        held = folded.filter(F.col("fold") == i).withColumn(label, F.col(label).cast("double"))
        s = positive_probability(m.transform(held)).select("fold", "p", F.col(label).cast("int").alias("y"))
        scored = s if scored is None else scored.unionByName(s)
    per = metrics_from_confusion(confusion(scored, 0.5, by=["fold"])).select("fold", "f05")
    return per.join(auc(scored, by=["fold"]), "fold")
