"""Per-row additive explanations of boosted-tree margins.

Path-dependent tree Shapley values (Lundberg et al., 2018).  For one leaf
reached through the unique features U (|U| = L) with cover ratios z_j
(training rows following the path's split / rows at its parent, multiplied
over repeated splits of a feature) and row indicators o_j (the row satisfies
every split of feature j on the path), the leaf contributes

    phi_i += v * (o_i - z_i) * sum_s c_s(i) * s! (L - s - 1)! / L!

where c_s(i) is the t^s coefficient of prod_{j != i} (z_j + o_j t).  Summing
over leaves and trees (weighted by the tree weights) gives contributions that
add up, with the base value sum(v * prod z), to the model margin.

The tree table is read from the saved model and is bounded by the model's
parameters (trees x 2^(depth+1) nodes); it travels to the tasks inside the
function closure.  Rows are scored in Arrow batches by ``mapInPandas``:
all work is vectorised over the rows of a batch, per leaf.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staywise.session import checkpoint_dir


def tree_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The saved node table of the boosted trees (one row per node)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/staywise-trees-{uuid.uuid4().hex[:12]}"
    model.stages[-1].write().overwrite().save(path)
    d = spark.read.parquet(f"{path}/data")
    return d.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
                    "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"),
                    F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"))


def leaf_paths(nodes: list[dict], weights: Sequence[float]):
    """Per tree: list of leaves (value, [(feature, threshold, goes_left, z)])."""
    by_tree: dict[int, dict[int, dict]] = {}
    for n in nodes:
        by_tree.setdefault(n["treeID"], {})[n["id"]] = n
    trees = []
    for t in sorted(by_tree):
        tn = by_tree[t]
        leaves = []
        stack = [(0, [])]
        while stack:
            nid, path = stack.pop()
            n = tn[nid]
            if n["leftChild"] < 0:
                leaves.append((n["prediction"], path))
                continue
            for child, left in ((n["leftChild"], True), (n["rightChild"], False)):
                z = tn[child]["rawCount"] / n["rawCount"] if n["rawCount"] else 0.0
                stack.append((child, path + [(n["feature"], n["threshold"], left, z)]))
        trees.append((float(weights[t]), leaves))
    return trees


def _shapley_weights(L: int) -> np.ndarray:
    return np.array([math.factorial(s) * math.factorial(L - s - 1) / math.factorial(L) for s in range(L)])


def _terms(v: float, w: float, zs: np.ndarray) -> np.ndarray:
    """2^L x L: what a leaf of L features adds to each of them, by which of
    them the row satisfies (bit j of the row number: feature j)."""
    L = len(zs)
    os_ = (np.arange(1 << L)[:, None] >> np.arange(L) & 1).astype(float)
    sw, out = _shapley_weights(L), np.empty(os_.shape)
    for a in range(L):
        coef = np.zeros(os_.shape)
        coef[:, 0] = 1.0
        deg = 0
        for b in range(L):
            if b == a:
                continue
            nxt = coef * zs[b]
            nxt[:, 1:deg + 2] += coef[:, 0:deg + 1] * os_[:, b:b + 1]
            coef = nxt
            deg += 1
        out[:, a] = w * v * (os_[:, a] - zs[a]) * (coef @ sw)
    return out


def leaf_terms(trees) -> tuple[list, float]:
    """Per leaf the features of its path, each with its conditions, and what
    they get (``_terms``); the base value.  A path of d splits has at most 2^d
    cases, so the rows only look theirs up."""
    leaves, base = [], 0.0
    for w, paths in trees:
        for v, path in paths:
            feats: dict[int, list] = {}
            for f, thr, left, z in path:
                at = feats.setdefault(f, [1.0, []])
                at[0] *= z
                at[1].append((thr, left))
            zs = np.array([z for z, _ in feats.values()])
            base += w * v * float(np.prod(zs)) if len(zs) else w * v
            if feats:
                leaves.append(([(f, tests) for f, (_, tests) in feats.items()], np.ascontiguousarray(_terms(v, w, zs).T)))
    return leaves, base


#: Rows that are explained at a time: what a leaf reads stays in the core's cache.
CHUNK_ROWS = 4096


def shap_batch(X: np.ndarray, trees) -> tuple[np.ndarray, float]:
    """Contributions (n x features) and the base value for a batch of rows."""
    leaves, base = leaf_terms(trees)
    return _shap(X, leaves), base


def _shap(X: np.ndarray, leaves: list) -> np.ndarray:
    phi = np.zeros(X.shape[::-1])
    for lo in range(0, len(X), CHUNK_ROWS):
        x, out = np.ascontiguousarray(X[lo:lo + CHUNK_ROWS].T), phi[:, lo:lo + CHUNK_ROWS]
        passed: dict[tuple, np.ndarray] = {}  # a split's outcome serves all leaves below it
        for feats, terms in leaves:
            case = np.zeros(x.shape[1], np.int64)
            for j, (f, tests) in enumerate(feats):
                ok = None
                for thr, left in tests:
                    if (f, thr, left) not in passed:
                        passed[f, thr, left] = (x[f] <= thr) if left else (x[f] > thr)
                    ok = passed[f, thr, left] if ok is None else ok & passed[f, thr, left]
                case += ok.astype(np.int64) << j
            for j, (f, _) in enumerate(feats):
                out[f] += terms[j][case]
    return np.ascontiguousarray(phi.T)


def explain(spark: SparkSession, df: DataFrame, model: PipelineModel, features: Sequence[str],
            key: str = "id") -> DataFrame:
    """Long form (key, feature, value, contribution) plus one
    ``__base__`` row per key; contributions + base = margin."""
    from staywise.session import ship_package
    ship_package(spark)
    nodes = [r.asDict() for r in tree_table(spark, model).collect()]  # bounded by the model parameters
    leaves, base = leaf_terms(leaf_paths(nodes, model.stages[-1].treeWeights))
    prep = PipelineModel(stages=model.stages[:-1]).transform(df)
    fcol = model.stages[-1].getFeaturesCol()
    rows = prep.select(F.col(key).alias("key"), vector_to_array(F.col(fcol)).alias("x"),
                       *[F.col(c).cast("double").alias(f"v_{i}") for i, c in enumerate(features)])
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf["x"].to_numpy())
            phi = _shap(X, leaves)
            k = np.repeat(pdf["key"].to_numpy(), len(names) + 1)
            feat = np.tile(np.array(names + ["__base__"], dtype=object), len(pdf))
            vals = np.column_stack([pdf[[f"v_{i}" for i in range(len(names))]].to_numpy(),
                                    np.full(len(pdf), np.nan)]).ravel()
            contrib = np.column_stack([phi, np.full(len(pdf), base)]).ravel()
            yield pd.DataFrame({"key": k, "feature": feat, "value": vals, "contribution": contrib})
    out = rows.mapInPandas(run, "key long, feature string, value double, contribution double")
    return out.withColumnRenamed("key", key)


def top_contributions(long: DataFrame, n: int = 3, key: str = "id") -> DataFrame:
    """the n largest |contribution| per row (window per key: at most
    one row per feature)."""
    w = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), F.col("feature"))
    return (long.filter(F.col("feature") != "__base__").withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n)
            .withColumn("direction", F.when(F.col("contribution") > 0, "increases_risk")
                        .otherwise("decreases_risk")))


def global_importance(long: DataFrame) -> DataFrame:
    """Mean |contribution| per feature, 4 decimals, with its rank
    (largest first) and label."""
    out = (long.filter(F.col("feature") != "__base__").groupBy("feature")
           .agg(F.round(F.avg(F.abs("contribution")), 4).alias("mean_abs_contribution")))
    labels = F.create_map(*[F.lit(x) for kv in FEATURE_LABELS.items() for x in kv])
    w = Window.orderBy(F.col("mean_abs_contribution").desc(), "feature")  # one row per feature
    return (out.withColumn("rank", F.row_number().over(w))
            .withColumn("label", F.coalesce(F.try_element_at(labels, F.col("feature")), F.col("feature"))))


# Feature labels and the reason shown for each direction
# (high_risk = positive contribution, low_risk = otherwise).
FEATURE_LABELS = {
    "current_seat_count": "Client seat count",
    "no_replacement": "No replacement lined up",
    "replacement_urgency": "Replacement urgency/timeline",
    "client_tenure_at_termination": "Client tenure length",
    "termination_type_encoded": "Termination type",
    "checkin_frequency_encoded": "Check-in frequency",
    "days_since_checkin": "Days since last check-in",
    "days_since_communication": "Days since last communication",
    "offered_discount": "Discount/relief offered",
    "geo_encoded": "Geo-location",
    "health_score": "Client health score",
    "had_pip": "PIP was implemented",
}
FEATURE_REASONS = {
    "current_seat_count": ("Larger seat count — higher revenue at stake", "Smaller engagement — lower exposure"),
    "no_replacement": ("No replacement is being lined up", "Replacement is in progress"),
    "replacement_urgency": ("Urgent replacement timeline", "No urgency on replacement"),
    "client_tenure_at_termination": ("Short client tenure — not yet embedded",
                                     "Long-standing relationship — more invested"),
    "termination_type_encoded": ("Termination type indicates higher risk", "Termination type is routine/planned"),
    "checkin_frequency_encoded": ("Low check-in frequency", "Regular check-in cadence maintained"),
    "days_since_checkin": ("No recent check-in with client", "Recent check-in completed"),
    "days_since_communication": ("No recent communication", "Active communication maintained"),
    "offered_discount": ("Had to offer discount to retain (still at risk)",
                         "No discount needed — organically satisfied"),
    "geo_encoded": ("Region shows higher churn patterns", "Region is stable"),
    "health_score": ("Client health score is low", "Strong client health score"),
    "had_pip": ("PIP was implemented — performance concerns", "No PIP history — clean record"),
}


def reason_text(top: DataFrame) -> DataFrame:
    """Label and reason per (feature, direction), falling back to the
    label and then the feature name; impact rounded to 4."""
    labels = F.create_map(*[F.lit(x) for kv in FEATURE_LABELS.items() for x in kv])
    reasons = F.create_map(*[F.lit(x) for f, (hi, lo) in FEATURE_REASONS.items()
                             for x in (f"{f}:high_risk", hi, f"{f}:low_risk", lo)])
    direction = F.when(F.col("contribution") > 0, "high_risk").otherwise("low_risk")
    label = F.coalesce(F.try_element_at(labels, F.col("feature")), F.col("feature"))
    reason = F.coalesce(F.try_element_at(reasons, F.concat(F.col("feature"), F.lit(":"), direction)), label)
    return top.withColumn("label", label).withColumn("reason", reason).withColumn(
        "impact", F.round("contribution", 4))
