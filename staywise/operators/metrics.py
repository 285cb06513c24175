"""Classification metrics on (label, score) rows and deterministic
stratified splits (D11-D16, D20-D23, K1-K3, K7, K8).

Ordered statistics (AUC, PR curve, quantiles) need prefix sums over a global
order.  Rows are first grouped by their exact sort value (partial aggregation:
a hot value is one row per map task); the distinct values are then
range-partitioned by sampled bounds, so that crowded values spread as evenly as
any, and running sums add up inside the parts and over the parts' totals
(``ordering.running_sums``); scores are counted by their leading digits first
(``ordering.sums_above``).  Ranks for splits use hash buckets, which are even
by nature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise.functions.risk import fbeta
from staywise.operators.ordering import running_sums, sums_above

# The threshold grid searched for the best F0.5 (start 0.5).
THRESHOLD_GRID = (0.40, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)


def _one_row_join(*dfs: DataFrame) -> DataFrame:
    """Side by side of one-row aggregates without a join: the rows are united
    (missing columns null) and collapsed by one aggregate."""
    u = dfs[0]
    for d in dfs[1:]:
        u = u.unionByName(d, allowMissingColumns=True)
    cols = []
    for d in dfs:
        cols += [c for c in d.columns if c not in cols]
    return u.agg(*[F.max(c).alias(c) for c in cols])


def confusion(df: DataFrame, t: float = 0.5, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """TN FP FN TP at ``p >= t`` plus FP / (TN + FP) with a 0 guard."""
    pred = F.col(p) >= F.lit(t)
    pos = F.col(y) == 1
    agg = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count_if(~pred & ~pos).alias("tn"), F.count_if(pred & ~pos).alias("fp"),
        F.count_if(~pred & pos).alias("fn"), F.count_if(pred & pos).alias("tp"))
    den = F.col("tn") + F.col("fp")
    return agg.withColumn("false_positive_rate", F.when(den > 0, F.col("fp") / den).otherwise(F.lit(0.0)))


def _ratio0(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metrics_from_confusion(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    prec, rec = _ratio0(tp, tp + fp), _ratio0(tp, tp + fn)
    return (c.withColumn("accuracy", _ratio0(tp + tn, tp + tn + fp + fn))
             .withColumn("precision", prec).withColumn("recall", rec)
             .withColumn("f1", fbeta(prec, rec, 1.0)).withColumn("f05", fbeta(prec, rec, 0.5)))


def score_counts(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Positives / negatives per distinct score (partial aggregation)."""
    return (df.groupBy(*by, F.col(p).alias("score"))
            .agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                 F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("bigint").alias("neg")))


def counts_above(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each distinct score: positives and negatives with a strictly greater
    score (``pos_above``, ``neg_above``) and the totals of its group.  Scores are
    counted by their leading digits first, so no task holds them all, and nothing
    runs while the plan is made."""
    return sums_above(counts, list(by), "score", {"pos_above": "pos", "neg_above": "neg"}, {"total_pos": "pos_above", "total_neg": "neg_above"})


def auc(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC, ties count one half; 0.5 when one class is empty."""
    return auc_of(score_counts(df, y, p, by), by)


def auc_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """sum(neg * (pos_above + pos / 2)) / (P * N) of counts by distinct score."""
    ca = counts_above(counts, by)
    g = ca.groupBy(*by) if by else ca.groupBy()
    agg = g.agg(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0)).alias("_u"),
                F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return agg.select(*by, F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_u") / (F.col("_P") * F.col("_N")))
                      .otherwise(F.lit(0.5)).alias("auc_roc"))


def pr_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Precision and recall when flagging ``score >= threshold``, one
    row per distinct score."""
    return pr_curve_of(score_counts(df, y, p))


def pr_curve_of(counts: DataFrame) -> DataFrame:
    ca = counts_above(counts)
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("neg_above") + F.col("neg")
    return ca.select(F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                     (tp / (tp + fp)).alias("precision"),
                     F.when(F.col("total_pos") > 0, tp / F.col("total_pos")).otherwise(F.lit(0.0)).alias("recall"))


def quantiles_of(ranked: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(p, q) with linear interpolation (h = (n - 1) p) from distinct scores with
    ``n`` rows each, ``start`` rows before them and ``total`` rows in all."""
    targets = F.array(*[F.struct(F.lit(float(p)).alias("p"), ((F.col("total") - 1) * p).alias("h")) for p in probs])
    end = F.col("start") + F.col("n")
    hit = ranked.select("score", "start", end.alias("end"), F.explode(F.filter(
        targets, lambda t: (F.ceil(t["h"]) >= F.col("start")) & (F.floor(t["h"]) < end))).alias("t"))
    low = F.when((F.floor("t.h") >= F.col("start")) & (F.floor("t.h") < F.col("end")), F.col("score"))
    high = F.when((F.ceil("t.h") >= F.col("start")) & (F.ceil("t.h") < F.col("end")), F.col("score"))
    per = hit.groupBy(F.col("t.p").alias("p")).agg(F.max(low).alias("lo"), F.max(high).alias("hi"), F.max("t.h").alias("h"))
    return per.select("p", (F.col("lo") + (F.col("h") - F.floor("h")) * (F.col("hi") - F.col("lo"))).alias("q"))


def best_threshold_curve(curve: DataFrame) -> DataFrame:
    """K8: argmax of F0.5 (with the 1e-8 guard) over the curve; ties go to the
    smaller threshold."""
    f = ((1 + 0.25) * (F.col("precision") * F.col("recall"))
         / ((0.25 * F.col("precision")) + F.col("recall") + 1e-8))
    return (curve.withColumn("f05", f).orderBy(F.col("f05").desc(), F.col("threshold").asc()).limit(1)
            .select("threshold", "precision", "recall", "f05"))


def threshold_sweep(df: DataFrame, grid: Sequence[float] = THRESHOLD_GRID, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F0.5 and flagged count per grid threshold;
    thresholds that flag nothing are skipped.  Each row is counted once under
    the number of grid thresholds it passes - no join with the grid."""
    grid = sorted(grid)
    passes = F.size(F.filter(F.array(*[F.lit(float(t)) for t in grid]), lambda t: t <= F.col(p)))
    counts = (df.groupBy(passes.alias("k"))
              .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count(F.lit(1)).alias("n")))
    m = len(grid)
    # every k in 0..m present once; "rows passing threshold i" = rows with k >= i
    ks = df.sparkSession.range(0, m + 1).select(F.col("id").cast("int").alias("k"))
    full = ks.join(counts, "k", "left").na.fill(0, ["pos", "n"])
    cum = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)  # <= m + 1 rows
    per = (full.select("k", F.sum("pos").over(cum).alias("tp"), F.sum("n").over(cum).alias("flagged"),
                       F.sum("pos").over(Window.partitionBy()).alias("_P"))
           .filter(F.col("k") >= 1)
           .select(F.col("k").alias("i"), "tp", "flagged",
                   F.element_at(F.array(*[F.lit(float(t)) for t in grid]), F.col("k")).alias("threshold"),
                   "_P"))
    prec = _ratio0(F.col("tp"), F.col("flagged"))
    rec = _ratio0(F.col("tp"), F.col("_P"))
    return (per.filter(F.col("flagged") > 0)
            .select("threshold", prec.alias("precision"), rec.alias("recall"),
                    fbeta(prec, rec, 0.5).alias("f05"), "flagged", F.col("i").alias("grid_index")))


def best_threshold_grid(sweep: DataFrame, start: float = 0.5) -> DataFrame:
    """K7: walk the grid in order, keep a threshold only when its F0.5 is
    strictly greater (first wins); ``start`` when nothing beats 0."""
    best = sweep.filter(F.col("f05") > 0).agg(
        F.max_by("threshold", F.struct(F.col("f05"), -F.col("grid_index"))).alias("t"),
        F.max("f05").alias("f05"))
    return best.select(F.coalesce(F.col("t"), F.lit(start)).alias("threshold"),
                       F.coalesce(F.col("f05"), F.lit(0.0)).alias("f05"))


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Balanced weight n / (k * n_class) per label and
    scale_pos_weight = neg / max(pos, 1).  Totals are windows over the
    per-label table (one row per label value)."""
    per = df.groupBy(F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("n_label"))
    w = Window.partitionBy()
    pos = F.sum(F.when(F.col("label") == 1, F.col("n_label")).otherwise(0)).over(w)
    neg = F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n_label"))).over(w)
    return per.select("label", "n_label",
                      (F.sum("n_label").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_label"))).alias("weight"),
                      (neg / F.greatest(pos, F.lit(1))).alias("scale_pos_weight"))


def label_balance(df: DataFrame, y: str = "y") -> DataFrame:
    """Samples, positives, positive rate."""
    return df.agg(F.count(F.lit(1)).alias("samples"),
                  F.count_if(F.col(y) == 1).alias("positives")).withColumn(
        "positive_rate", F.when(F.col("samples") > 0, F.col("positives") / F.col("samples")).otherwise(0.0))


def hash_order(key: Column, seed: int) -> Column:
    """Deterministic pseudo-random order key: md5 of 'key:seed' (hex)."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def positions(df: DataFrame, part: Sequence[str], h: str, tiebreak: str, hex_digits: int = 4) -> DataFrame:
    """0-based position of each row within ``part`` in (h, tiebreak) order,
    exact and distributed: rows are bucketed by the first hex digits of h;
    bucket counts give offsets; the in-bucket rank is a window per bucket."""
    part = list(part)
    d = df.withColumn("_hb", F.conv(F.substring(F.col(h), 1, hex_digits), 16, 10).cast("int"))
    bc = d.groupBy(*part, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(*part).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    off = bc.select(*part, "_hb", F.coalesce(F.sum("_c").over(wb), F.lit(0)).alias("_off"))
    wi = Window.partitionBy(*part, "_hb").orderBy(F.col(h), F.col(tiebreak))
    return (d.join(off, [*part, "_hb"], "inner")
            .withColumn("pos", F.col("_off") + F.row_number().over(wi) - 1).drop("_hb", "_off"))


def stratified_split(df: DataFrame, train_frac: float = 0.8, y: str = "y", key: str = "id",
                     seed: int = 42) -> DataFrame:
    """K1: per label exactly round(train_frac * n_label) rows go to 'train',
    chosen by a seeded hash order; deterministic under recomputation."""
    d = df.withColumn("_h", hash_order(F.col(key), seed))
    pos = positions(d, [y], "_h", key)
    n = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    j = pos.join(n, y)  # one row per label value
    return (j.withColumn("split", F.when(F.col("pos") < F.round(F.col("_n") * train_frac), "train")
                         .otherwise("test")).drop("_h", "_n", "pos"))


def stratified_folds(df: DataFrame, k: int = 5, y: str = "y", key: str = "id", seed: int = 42) -> DataFrame:
    """K2: fold = position within label (seeded hash order) modulo k."""
    d = df.withColumn("_h", hash_order(F.col(key), seed))
    return positions(d, [y], "_h", key).withColumn("fold", (F.col("pos") % k).cast("int")).drop("_h", "pos")


def standardize(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("id",), digits: int | None = 6) -> DataFrame:
    """K3: (x - mean) / population std, fitted on ``df``.  The fitted
    parameters (two numbers per column) are one aggregate row, inlined as
    literals the way a fitted scaler carries them."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    st = df.agg(*aggs).first()
    out = []
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        z = F.lit(0.0) if not s else (F.col(c) - F.lit(m)) / F.lit(s)
        out.append((F.round(z, digits) if digits is not None else z).alias(c))
    return df.select(*keep, *out)


def exact_quantiles(long: DataFrame, group: str, value: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (h = (n - 1) p, as pandas),
    per group, without gathering a group's values in one task: distinct
    (group, value) counts (partial aggregation) are summed in order over even
    ranges, and each distinct value keeps the target ranks that fall in its
    [start, start + count) range.  Returns (group, p, q)."""
    counts = long.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    n = counts.groupBy(group).agg(F.sum("_c").alias("_n"))  # one row per group
    ranked = running_sums(counts, [group], [F.col(value)], {"_start": "_c"}).join(n, group)
    targets = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(k).alias("side"),
                                 (F.floor((F.col("_n") - 1) * p) if k == 0 else F.ceil((F.col("_n") - 1) * p))
                                 .alias("rank"), ((F.col("_n") - 1) * p).alias("h"))
                       for p in probs for k in (0, 1)])
    hits = ranked.select(group, value, F.explode(F.filter(
        targets, lambda t: (t["rank"] >= F.col("_start")) & (t["rank"] < F.col("_start") + F.col("_c")))).alias("t"))
    picked = hits.groupBy(group, F.col("t.p").alias("p")).agg(
        F.max(F.when(F.col("t.side") == 0, F.col(value))).alias("_x0"),
        F.max(F.when(F.col("t.side") == 1, F.col(value))).alias("_x1"),
        F.max("t.h").alias("_h"))
    return picked.select(group, "p", (F.col("_x0") + (F.col("_h") - F.floor("_h")) * (F.col("_x1") - F.col("_x0")))
                         .alias("q"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles, max per column (rounded 2) in
    long form; quartiles are exact order statistics computed distributed
    (``exact_quantiles``), never a per-feature list of values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                                         for c in cols])).alias("x")).select("x.*")
    v = F.col("v")
    moments = long.groupBy("feature").agg(
        F.count(v).alias("count"), F.round(F.avg(v), 2).alias("mean"), F.round(F.stddev_samp(v), 2).alias("std"),
        F.round(F.min(v), 2).alias("min"), F.round(F.max(v), 2).alias("max"))
    q = (exact_quantiles(long, "feature", "v", (0.25, 0.5, 0.75)).groupBy("feature")
         .agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("q"))), 2).alias(name)
                for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]))
    # both sides have one row per described column
    return moments.join(q, "feature").select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
