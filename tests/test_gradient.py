"""K4-K6, K9: the library's trees grown side by side, against the library itself."""

import numpy as np
import pytest
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from staywise.operators import boosting as B
from staywise.operators import gradient as G
from staywise.operators import model as MO
from staywise.plans import q_model as QM

COLS = ["a", "b", "c"]


def frame(spark, n=1500, seed=3):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 4, n), r.normal(size=n).round(1)])
    y = (x[:, 0] + x[:, 1] + r.normal(size=n) > 2).astype(int)
    rows = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return MO.materialize(spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(3, "id"))


def test_draws_are_the_librarys(spark):
    n = 700
    want = spark.range(0, 2 * n, 1, 2).select(F.spark_partition_id().alias("p"), *[(F.rand(43 + t) < 0.8).cast("int").alias(f"t{t}") for t in (0, 61)]).toPandas()
    for p in (0, 1):
        d = G.Draws(42, p, 62, 0.8)
        got = np.concatenate([d.next(300), d.next(7), d.next(n - 307)], axis=1)
        for t in (0, 61):
            assert ((got[t // G.BITS] >> np.uint64(t % G.BITS) & np.uint64(1)).astype(int) == want[want.p == p][f"t{t}"].to_numpy()).all()


@pytest.mark.parametrize("whole", [1 << 30, 0])  # in a task, and in passes over several blocks
def test_models_equal_the_librarys(spark, monkeypatch, whole):
    """grown side by side, each is what the library fits on its part."""
    monkeypatch.setattr(B, "WHOLE_BYTES", whole)
    monkeypatch.setattr(B, "BLOCK_ROWS", 200)
    df = frame(spark).withColumn("y", F.col("y").cast("double"))
    parts = [df.where("id % 3 <> 0"), df.where("id % 3 <> 1")]
    pipe = MO._pipeline(COLS, "y", {**MO.DEFAULT_PARAMS, "maxIter": 4, "maxDepth": 3}, None, True)
    for part, m in zip(parts, G.fit([G.Part(x) for x in parts], COLS, "y", pipe, 2)):
        want = pipe.fit(part)
        both = MO.positive_probability(want.transform(df)).select("id", F.col("p").alias("q")).join(MO.positive_probability(m.transform(df)).select("id", "p"), "id")
        assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-6
        assert [t.numNodes for t in m.stages[-1].trees] == [t.numNodes for t in want.stages[-1].trees]
        assert np.allclose(m.stages[-1].featureImportances.toArray(), want.stages[-1].featureImportances.toArray(), atol=1e-6)


def test_grid_scores_equal_the_librarys(spark):
    df = frame(spark, 600)
    grid = {"maxDepth": (1, 2), "maxIter": (2, 4), "minInfoGain": (0.0, 0.05)}
    got = MO.grid_search(df, COLS, "y", grid, k=3)
    folded, _ = MO._folded(df, COLS, "y", 3, "id", 42)
    ev = MO.MulticlassClassificationEvaluator(labelCol="y", metricName="fMeasureByLabel", beta=0.5, metricLabel=1.0)
    est = MO._pipeline(COLS, "y", MO.DEFAULT_PARAMS, None, True)
    gbt, maps = est.getStages()[-1], []
    for m in got.getEstimatorParamMaps():
        maps.append({gbt.getParam(p.name): v for p, v in m.items()})
    want = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, numFolds=3, foldCol="fold", seed=42).fit(folded.withColumn("y", F.col("y").cast("double")))
    assert len(maps) == 8 and np.allclose(got.avgMetrics, want.avgMetrics, atol=1e-9)
    assert got.bestModel.stages[-1].getNumTrees == want.bestModel.stages[-1].getNumTrees


def test_grid_search_is_the_whole_grid(spark, monkeypatch):
    """F8: 162 combinations over five folds, not three depths over three."""
    seen = {}

    def tallies(parts, features, label, pipe, combinations, at_once):
        seen.update(parts=len(parts), combinations={tuple(sorted(c.items())) for c in combinations})
        return [[(1, 0, 0)] * len(parts) for _ in combinations]
    df = frame(spark, 300).withColumnRenamed("y", "client_lost")
    monkeypatch.setattr(QM, "churn_split", lambda *a: (df, None))
    monkeypatch.setattr(QM.FT, "TRAINING_MATRIX_12", COLS)
    monkeypatch.setattr(MO.gradient, "tallies", tallies)
    monkeypatch.setitem(MO.DEFAULT_PARAMS, "seed", 42)
    rows = QM.grid_search(spark, "none").collect()
    assert len(rows) == 162 and {r.fits for r in rows} == {810} and seen["parts"] == 5 and len(seen["combinations"]) == 162


def test_rows_that_the_library_refuses(spark):
    df = frame(spark, 50).withColumn("y", F.col("y").cast("double"))
    pipe = MO._pipeline(COLS, "y", {**MO.DEFAULT_PARAMS, "maxIter": 1}, None, True)
    for bad in (df.limit(0), df.withColumn("y", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            G.fit([G.Part(bad)], COLS, "y", pipe)


def test_features_counted_together():
    """every feature in one group, none past the bound but alone."""
    sizes = [256, 5, 30, 2, 5000, 7]
    own = B.together(sizes, 4096)
    assert sorted(j for o in own for j in o) == list(range(6))
    assert all(len(o) == 1 or np.prod([sizes[j] for j in o]) <= 4096 for o in own)
