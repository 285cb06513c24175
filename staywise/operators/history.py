"""Prediction history: latest rows, daily upsert, validation, orphans and the
two-strike level confirmation (A14-A18, C3, C4, C6-C8, E1-E5, E8, D9).

Scale notes
-----------
* "Latest per key" is an aggregation (``max_by`` of the row over the ordering
  columns), not a window: partial aggregation collapses a hot
  key to one row per map task before the shuffle, so a key holding a third of
  all rows never lands whole in one task.
* The confirmation rule runs on the one-row-per-entity-per-day series (the
  upsert grain), so one window partition holds at most one row per day of an
  entity's history; the recursion of the rule is resolved to two ``lag``s
  (see ``confirm_levels``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise.functions.dates import ntz_micros
from staywise.functions.risk import LEVELS, STRICT_BANDS, risk_level, risk_score


def latest(df: DataFrame, key: str | Sequence[str], order: Sequence[str] = ("prediction_date", "id")) -> DataFrame:
    """Exactly one row per key, the greatest by ``order`` (later
    columns break ties).  Only the order columns are compared, so the others
    may be of any type (maps too).  Output keeps the input's column order."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return out.select(*keys, "_r.*").select(*df.columns)


def latest_with_ties(df: DataFrame, key: str, date_col: str = "prediction_date") -> DataFrame:
    """Every row whose date equals its key's maximum; null keys never
    match.  Per-key maxima (partially aggregated) are semi-joined back on
    (key, date), so a hot key is spread over the shuffle by its dates."""
    mx = (df.filter(F.col(key).isNotNull()).groupBy(key)
          .agg(F.max(date_col).alias(date_col)))
    return df.join(mx, [key, date_col], "left_semi")


def with_day(df: DataFrame, ts_col: str = "prediction_date", day_col: str = "prediction_day") -> DataFrame:
    return df.withColumn(day_col, F.to_date(F.col(ts_col)))


def one_per_day(df: DataFrame, key: str, ts_col: str = "prediction_date",
                tiebreak: str = "id", day_col: str = "prediction_day") -> DataFrame:
    """Keep the latest row per (entity, calendar day); the day is
    ``day_col`` where the rows have it, else the date of ``ts_col``."""
    d = df if day_col in df.columns else with_day(df, ts_col, day_col)
    return latest(d, [key, day_col], (ts_col, tiebreak))


def upsert_daily(new: DataFrame, old: DataFrame, key: str, ts_col: str = "prediction_date",
                 tiebreak: str = "id", day_col: str = "prediction_day") -> DataFrame:
    """One row per entity per day, the later row wins; rows of other
    days are kept.  The caller writes the result to a new version directory
    (see ``sources.store``) - never over the path being read."""
    return one_per_day(old.unionByName(new, allowMissingColumns=True), key, ts_col, tiebreak, day_col)


def score_levels(df: DataFrame, p_col: str = "churn_probability", bands=STRICT_BANDS) -> DataFrame:
    return df.withColumn("risk_level", risk_level(p_col, bands)).withColumn("risk_score", risk_score(p_col))


def confirm_levels(daily: DataFrame, key: str, day_col: str = "prediction_day",
                   level_col: str = "risk_level", out_col: str = "confirmed_level") -> DataFrame:
    """E4 two-strike rule over an entity's daily series.

    Rule (per row, against the previous *confirmed* level of the entity):
    critical stays critical only when the previous confirmed level is critical
    or high (else high); high after a confirmed low becomes medium; the first
    row of an entity is unchanged.

    The fold reads its own output, but only through a bounded depth: a
    confirmed level is low exactly when the raw level is low, and it is in
    {low, medium} exactly when the raw level is low or medium, or high right
    after a raw low.  So the previous confirmed level is decided by the raw
    levels of the two previous rows, and the fold becomes two ``lag``s - no
    per-entity ``collect_list`` and no sequential loop.
    """
    w = Window.partitionBy(key).orderBy(day_col)
    lvl = F.col(level_col)
    p1 = F.lag(lvl, 1).over(w)
    p2 = F.lag(lvl, 2).over(w)
    prev_low_or_medium = p1.isin("low", "medium") | ((p1 == "high") & F.coalesce(p2 == "low", F.lit(False)))
    confirmed = (F.when(p1.isNull(), lvl)
                 .when((lvl == "critical") & prev_low_or_medium, F.lit("high"))
                 .when((lvl == "high") & (p1 == "low"), F.lit("medium"))
                 .otherwise(lvl))
    return daily.withColumn(out_col, confirmed)


def confirm_step(level: Column, previous_confirmed: Column) -> Column:
    """One application of the two-strike rule against a known previous
    confirmed level (null = no previous prediction)."""
    return (F.when(previous_confirmed.isNull(), level)
            .when((level == "critical") & ~previous_confirmed.isin("critical", "high"), F.lit("high"))
            .when((level == "high") & (previous_confirmed == "low"), F.lit("medium"))
            .otherwise(level))


def previous_level(new: DataFrame, hist: DataFrame, key: str, batch_day: str,
                   day_col: str = "prediction_day", level_col: str = "risk_level") -> DataFrame:
    """For each row of the batch scored on ``batch_day``, the latest history
    row of the same entity from an earlier day (a backward as-of join; a
    same-day re-run never confirms itself, trap T10).  History is reduced to
    one row per entity by partial aggregation before it meets the new rows."""
    cut = F.to_date(F.lit(batch_day))
    h = hist.filter(F.col(day_col) < cut).select(key, day_col, level_col)
    prev = latest(h, key, (day_col,)).select(
        F.col(key), F.col(day_col).alias("previous_day"), F.col(level_col).alias("previous_level"))
    return new.join(prev, key, "left")


def validate(df: DataFrame, p_col: str = "churn_probability", score_col: str = "risk_score",
             level_col: str = "risk_level", name_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split into (good, quarantine); quarantine rows carry the array of
    failed checks in ``reasons``."""
    p, s, lv = F.col(p_col), F.col(score_col), F.col(level_col)
    checks = [
        (p.isNull() | (p < 0) | (p > 1), "probability_out_of_range"),
        (s.isNull() | (s < 0) | (s > 100), "score_out_of_range"),
        (lv.isNull() | ~lv.isin(*LEVELS), "unknown_level"),
    ]
    if name_col:
        checks.append((F.col(name_col).isNull(), "missing_name"))
    reasons = F.filter(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]), lambda x: x.isNotNull())
    tagged = df.withColumn("reasons", reasons)
    good = tagged.filter(F.size("reasons") == 0).drop("reasons")
    bad = tagged.filter(F.size("reasons") > 0)
    return good, bad


def validation_counts(df: DataFrame, **kw) -> DataFrame:
    """A18 as one aggregation: total, valid and quarantined rows."""
    p_col = kw.get("p_col", "churn_probability")
    s_col = kw.get("score_col", "risk_score")
    l_col = kw.get("level_col", "risk_level")
    ok = (F.col(p_col).between(0, 1) & F.col(s_col).between(0, 100) & F.col(l_col).isin(*LEVELS))
    ok = F.coalesce(ok, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(ok).alias("valid_rows"),
                  F.count_if(~ok).alias("quarantined_rows"))


def orphans(df: DataFrame, ref: DataFrame, key: str, ref_key: str = "id") -> DataFrame:
    """Rows whose foreign key has no row in ``ref`` (anti join)."""
    return df.join(ref.select(F.col(ref_key).alias(key)), key, "left_anti")


def fk_valid(df: DataFrame, ref: DataFrame, key: str, ref_key: str = "id") -> DataFrame:
    return df.join(ref.select(F.col(ref_key).alias(key)), key, "left_semi")


def active(clients: DataFrame, null_aware: bool = True) -> DataFrame:
    """``is_active = true``, and where it is null ``status = 'active'``
    (``null_aware=False``: the older view, without the second term)."""
    yes = F.col("is_active") == F.lit(True)
    return clients.filter(yes | (F.col("is_active").isNull() & (F.col("status") == "active")) if null_aware else yes)


def latest_client_predictions(preds: DataFrame, clients: DataFrame,
                              order: Sequence[str] = ("prediction_date", "id"), null_aware: bool = True) -> DataFrame:
    """Latest prediction per client joined to active clients (B5).  The
    filter reaches the clients scan; picking the latest first shrinks the
    prediction side to one row per client before the join."""
    lat = latest(preds, "client_id", order)
    c = (active(clients, null_aware)
         .select(F.col("id").alias("client_id"), F.col("name").alias("client_name"),
                 "industry_type", "client_location", "health", F.col("status").alias("client_status")))
    return lat.join(c, "client_id", "inner")


def latest_member_predictions(preds: DataFrame, members: DataFrame, clients: DataFrame,
                              order: Sequence[str] = ("prediction_date", "id")) -> DataFrame:
    """C4: latest prediction per member, active members only, left-joined to the
    member's client name."""
    lat = latest(preds, "team_member_id", order)
    m = (members.filter(F.col("status") == F.lit("active"))
         .select(F.col("id").alias("team_member_id"), "first_name", "last_name", "role",
                 F.col("client_id").alias("member_client_id")))
    c = clients.select(F.col("id").alias("member_client_id"), F.col("name").alias("client_name"))
    return lat.join(m, "team_member_id", "inner").join(c, "member_client_id", "left")


def runs_from_predictions(preds: DataFrame, ts_col: str = "prediction_date",
                          version_col: str = "model_version") -> DataFrame:
    """Prediction runs = predictions grouped by (day, model version) with the
    level counts of D9 and start/end/duration of A20."""
    lv = F.col("risk_level")
    return (preds.groupBy(F.to_date(ts_col).alias("run_day"), F.col(version_col).alias("model_version"))
            .agg(F.count(F.lit(1)).alias("total_predictions"),
                 F.count_if(lv.isin("high", "critical")).alias("high_risk_count"),
                 F.count_if(lv == "medium").alias("medium_risk_count"),
                 F.count_if(lv == "low").alias("low_risk_count"),
                 F.min(ts_col).alias("start_time"), F.max(ts_col).alias("end_time"))
            .withColumn("duration_seconds",
                        F.floor((ntz_micros("end_time") - ntz_micros("start_time")) / 1_000_000)))


def embed_client(members: DataFrame, clients: DataFrame) -> DataFrame:
    """Each member row carries its client as a nested record (left join)."""
    c = clients.select(F.col("id").alias("client_id"),
                       F.struct(F.col("id"), F.col("name"), F.col("industry_type"),
                                F.col("client_location"), F.col("status")).alias("clients"))
    return members.join(c, "client_id", "left")
