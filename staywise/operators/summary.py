"""Summaries, feedback metrics, search and top-k over predictions and
training rows (D1-D10, D17, D18, F1-F4, B6-B9, B13-B15).

All summaries are single ``agg`` / ``groupBy().agg`` plans: partial
aggregation runs map-side, so the shuffle carries one row per group per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staywise.functions.values import parse_boolean, safe_ratio


def risk_summary(latest: DataFrame, p_col: str = "churn_probability", prefix: str = "clients", extra=()) -> DataFrame:
    """One row - totals per level band and mean probability over the
    latest-prediction view; 'needing attention' is strictly p > 0.5.  ``extra``
    aggregates are added to the row."""
    lv, p = F.col("risk_level"), F.col(p_col)
    noun = "clients" if prefix == "clients" else "team_members"
    return latest.agg(
        F.count(F.lit(1)).alias(f"total_{noun}"),
        F.count_if(lv.isin("high", "critical")).alias("high_risk_count"),
        F.count_if(lv == "medium").alias("medium_risk_count"),
        F.count_if(lv == "low").alias("low_risk_count"),
        F.round(F.avg(p), 6).alias("avg_probability"),
        F.count_if(p > 0.5).alias(f"{noun}_needing_attention"),
        *extra,
    )


def training_stats(terms: DataFrame) -> DataFrame:
    """Total rows, churned rows (client_lost parsed as boolean), distinct
    client names, churn rate (0 on an empty table)."""
    lost = parse_boolean("client_lost")
    return (terms.agg(F.count(F.lit(1)).alias("total_records"),
                      F.count_if(lost == 1).alias("churned_clients"),
                      F.count_distinct("client_name").alias("unique_clients"))
            .withColumn("churn_rate", F.when(F.col("total_records") > 0,
                                             F.round(F.col("churned_clients") / F.col("total_records"), 6))
                        .otherwise(F.lit(0.0))))


def health_distribution(terms: DataFrame, col: str = "health_text") -> DataFrame:
    """Rows per health value; null is its own group."""
    return terms.groupBy(F.col(col).alias("health")).agg(F.count(F.lit(1)).alias("n"))


def prediction_stats(preds: DataFrame, latest_ties: DataFrame, runs: DataFrame) -> DataFrame:
    """D3: totals plus the level distribution of the latest rows (ties kept),
    one output row per level.  The per-level rows and the one-row totals are
    united and the totals spread by a window over that (at most five-row)
    table - no join."""
    totals = preds.agg(F.count(F.lit(1)).alias("total_predictions"),
                       F.count_distinct("client_id").alias("unique_clients_scored"))
    n_runs = runs.agg(F.count(F.lit(1)).alias("total_prediction_runs"))
    dist = latest_ties.groupBy("risk_level").agg(F.count(F.lit(1)).alias("latest_count"))
    u = (dist.withColumn("_side", F.lit(0))
         .unionByName(totals.withColumn("_side", F.lit(1)), allowMissingColumns=True)
         .unionByName(n_runs.withColumn("_side", F.lit(2)), allowMissingColumns=True))
    w = Window.partitionBy()
    return (u.select("risk_level", "latest_count", "_side",
                     *[F.max(c).over(w).alias(c) for c in ("total_predictions", "unique_clients_scored",
                                                           "total_prediction_runs")])
            .filter(F.col("_side") == 0).drop("_side"))


def high_risk_clients(preds: DataFrame, threshold: float = 0.5, key: str = "client_id",
                      p_col: str = "churn_probability") -> DataFrame:
    """Over rows at or above the threshold, per client the maximum
    probability, the level and score of that row (max_by), and the last date."""
    p = F.col(p_col)
    return (preds.filter(p >= F.lit(threshold))
            .groupBy(key)
            .agg(F.max(p).alias("max_probability"),
                 F.max_by("risk_level", p).alias("risk_level"),
                 F.max_by("risk_score", p).alias("risk_score"),
                 F.max("prediction_date").alias("last_prediction_date")))


def feedback_dedup(fb: DataFrame) -> DataFrame:
    """One feedback row per (client, prediction_date), latest feedback wins."""
    from staywise.operators.history import latest
    return latest(fb, ["client_id", "prediction_date"], ("feedback_date", "actually_churned"))


def feedback_summary(fb: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Over feedback of the last ``days`` days before ``as_of``: totals,
    false-positive share and precision rounded to 3, null when empty."""
    cut = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = fb.filter(F.col("feedback_date") >= cut)
    ch = F.col("actually_churned")
    agg = recent.agg(F.count(F.lit(1)).alias("total_feedback"),
                     F.sum(F.when(ch, 1).otherwise(0)).cast("bigint").alias("true_positives"),
                     F.sum(F.when(~ch, 1).otherwise(0)).cast("bigint").alias("false_positives"))
    total = F.when(F.col("total_feedback") != 0, F.col("total_feedback"))
    return agg.select("*",
                      F.round(safe_ratio("false_positives", total), 3).alias("false_positive_rate"),
                      F.round(safe_ratio("true_positives", total), 3).alias("actual_precision"))


def false_positive_rate(fb: DataFrame, as_of: str, lookback_days: int = 90) -> DataFrame:
    """Unrounded shares (false discovery share of flagged feedback, trap
    T8) with a message row when there is no feedback."""
    cut = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(lookback_days)} DAYS")
    recent = fb.filter(F.col("feedback_date") >= cut)
    ch = F.col("actually_churned")
    agg = recent.agg(F.count(F.lit(1)).alias("feedback_count"),
                     F.count_if(ch).alias("true_positives"))
    n = F.col("feedback_count")
    return agg.select(
        "feedback_count", "true_positives",
        (n - F.col("true_positives")).alias("false_positives"),
        F.when(n > 0, (n - F.col("true_positives")) / n).otherwise(F.lit(0.0)).alias("false_positive_rate"),
        F.when(n > 0, F.col("true_positives") / n).otherwise(F.lit(0.0)).alias("precision_actual"),
        F.lit(lookback_days).cast("bigint").alias("lookback_days"),
        F.when(n == 0, F.lit("No feedback data yet")).alias("message"),
    )


def source_breakdown(rows: DataFrame, source_col: str = "_source", label_col: str = "churned") -> DataFrame:
    """Rows and positives per source."""
    return rows.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.sum(label_col).cast("bigint").alias("n_churned"))


def risk_distribution(df: DataFrame, level_col: str = "risk_level") -> DataFrame:
    """Rows per band and the share of the whole population.  The share
    window runs over the per-band table (at most four rows), not the data."""
    counts = df.groupBy(level_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def dashboard_cards(latest: DataFrame) -> DataFrame:
    """Per-level counts and the at-risk share (critical + high)."""
    lv = F.col("risk_level")
    agg = latest.agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(lv == "critical").alias("critical"),
                     F.count_if(lv == "high").alias("high"),
                     F.count_if(lv == "medium").alias("medium"),
                     F.count_if(lv == "low").alias("low"))
    return agg.withColumn("at_risk_share",
                          F.round(safe_ratio(F.col("critical") + F.col("high"),
                                             F.when(F.col("total") != 0, F.col("total"))), 6))


def dashboard_overview(clients: DataFrame, members: DataFrame) -> DataFrame:
    """D18, the whole card set in one row: clients per level with each level's
    share of all in percent, and the members' card (all, high and critical).
    Each side is one aggregation of its latest rows."""
    lv = F.col("risk_level")
    levels = ("critical", "high", "medium", "low")
    total = F.when(F.col("clients") != 0, F.col("clients"))
    c = clients.agg(F.count(F.lit(1)).alias("clients"), *[F.count_if(lv == x).alias(f"{x}_clients") for x in levels])
    c = c.withColumns({f"{x}_percent": F.round(safe_ratio(F.col(f"{x}_clients") * 100.0, total), 4) for x in levels})
    m = members.agg(F.count(F.lit(1)).alias("members"), F.count_if(lv.isin("high", "critical")).alias("members_at_risk"))
    both = c.unionByName(m, allowMissingColumns=True)
    return both.agg(*[F.max(x).alias(x) for x in both.columns])


def search(df: DataFrame, term: str, level: str = "all", fields=("client_name", "industry_type")) -> DataFrame:
    """Case-insensitive substring on any of ``fields`` (no wildcard
    meaning), and the level unless 'all'."""
    t = term.lower()
    hit = None
    for f in fields:
        c = F.coalesce(F.lower(F.col(f)).contains(t), F.lit(False))
        hit = c if hit is None else (hit | c)
    out = df.filter(hit)
    if level != "all":
        out = out.filter(F.col("risk_level") == F.lit(level))
    return out


def filter_names(df: DataFrame, names: str, col: str = "client_name") -> DataFrame:
    """Comma-separated list, trimmed, exact match."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    return df.filter(F.col(col).isin(*wanted))


def at_or_above(df: DataFrame, threshold: float, p_col: str = "churn_probability") -> DataFrame:
    """Inclusive threshold; the value is a literal parameter."""
    return df.filter(F.col(p_col) >= F.lit(threshold))


def top_at_risk(latest: DataFrame, n: int, p_col: str = "churn_probability", key: str = "client_id") -> DataFrame:
    """the n highest probabilities (ties by key).  ``orderBy().limit()``
    plans as TakeOrderedAndProject: each task keeps its own top n."""
    return latest.orderBy(F.col(p_col).desc(), F.col(key).asc()).limit(n)


def at_risk_reasons(latest_with_factors: DataFrame, n: int, factors_col: str = "top_risk_factors") -> DataFrame:
    """The first n critical/high entities, one row per factor."""
    top = (latest_with_factors.filter(F.col("risk_level").isin("critical", "high"))
           .orderBy(F.col("churn_probability").desc(), F.col("client_id").asc()).limit(n))
    return top.select("client_id", "risk_level", F.posexplode(factors_col).alias("factor_pos", "factor"))


def recent_runs(runs: DataFrame, n: int = 10, order_col: str = "start_time") -> DataFrame:
    """the n most recent runs."""
    return runs.orderBy(F.col(order_col).desc(), F.col("model_version").desc()).limit(n)


def run_level_counts(preds: DataFrame) -> DataFrame:
    """High (= high + critical), medium, low per run."""
    from staywise.operators.history import runs_from_predictions
    return runs_from_predictions(preds).select("run_day", "model_version", "high_risk_count",
                                               "medium_risk_count", "low_risk_count")


def risk_map(latest_cp: DataFrame, client_feats: DataFrame) -> DataFrame:
    """The scatter of filtered clients - tenure, score, name, industry,
    region and level (one row per client)."""
    f = client_feats.select(F.col("id").alias("client_id"), "tenure_months")
    return latest_cp.join(f, "client_id", "inner").select(
        "client_id", "client_name", F.col("industry_type").alias("industry"),
        F.col("client_location").alias("region"), "tenure_months", "risk_score", "risk_level")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """``SELECT DISTINCT`` (partial aggregation per task, then one shuffle)."""
    return df.select(col).distinct()
