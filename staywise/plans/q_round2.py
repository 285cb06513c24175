"""Registered queries that exercise what the other fixtures leave idle: text
dates, stored vocabularies, members' predictions, and the model jobs' outputs
recomputed from what they store."""

from __future__ import annotations

from pyspark.sql import functions as F

from staywise.functions.dates import parse_date
from staywise.functions.values import full_name
from staywise.operators import features as FT
from staywise.operators import history as H
from staywise.operators import metrics as M
from staywise.operators import model as MO
from staywise.operators.encode import fit_vocabulary, label_encode
from staywise.plans import q_model as QM
from staywise.plans.oracle_views import level_sql, score_sql, with_views
from staywise.plans.q_io import _store_folder
from staywise.plans.q_metrics import SPLIT_RANK
from staywise.plans.registry import query
from staywise.sources import adapters as A


@query("text_dates", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def text_dates(spark, sf):
    """H1/H2: order dates written in the three form spellings (the last one only
    where the day cannot be a month), with times, blanks and unreadable text."""
    from staywise.sources.tables import table
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    day_first = F.when(F.day("d") > 12, F.date_format("d", "d/M/yyyy")).otherwise(F.date_format("d", "M/d/yyyy"))
    text = (F.when(F.col("id") % 5 == 0, F.date_format("d", "yyyy-MM-dd"))
            .when(F.col("id") % 5 == 1, F.concat(F.lit("  "), F.date_format("d", "M/d/yyyy"), F.lit(" 10:30:00")))
            .when(F.col("id") % 5 == 2, F.concat(F.date_format("d", "yyyy-M-d"), F.lit(" ")))
            .when(F.col("id") % 5 == 3, day_first)
            .otherwise(F.element_at(F.array(F.lit(""), F.lit("TBA"), F.lit("2024-13-45")), (F.col("id") % 3 + 1).cast("int"))))
    return o.select("id", parse_date(text).alias("parsed"))


@query("encode_with_stored_vocabulary", with_views("""
SELECT c.id, CASE WHEN c.industry_type IN ('BUILDING', 'MACHINERY')
                  THEN CAST(c.industry_type = 'MACHINERY' AS BIGINT) + (SELECT 0) ELSE 99 END AS code
FROM clients c""", "clients"))
def encode_with_stored_vocabulary(spark, sf):
    """A vocabulary fitted on two industries, written and read again, applied
    to all clients; values that it lacks get the reserved code."""
    c = A.clients(spark, sf).select("id", "industry_type")
    folder = _store_folder(spark, "vocabulary")
    fit_vocabulary(c.filter(F.col("industry_type").isin("BUILDING", "MACHINERY")), "industry_type").write.parquet(folder)
    return label_encode(c, "industry_type", spark.read.parquet(folder), "code", unseen="OTHER", reserved_code=99).select("id", "code")


_MEMBER_LATEST = f"""
SELECT s.client_id AS team_member_id, s.id, s.churn_probability, {level_sql('s.churn_probability')} AS risk_level,
       concat(m.first_name, ' ', coalesce(m.last_name, '')) AS member_name, c.name AS client_name
FROM (SELECT p.*, row_number() OVER (PARTITION BY client_id ORDER BY prediction_date DESC, id DESC) AS rn FROM predictions p) s
JOIN team_members m ON m.id = s.client_id LEFT JOIN clients c ON c.id = m.client_id
WHERE s.rn = 1 AND m.status = 'Active'"""


@query("latest_member_predictions", with_views(_MEMBER_LATEST, "predictions", "team_members", "clients"))
def latest_member_predictions(spark, sf):
    """Latest prediction of every active member (the fixture's spelling
    of the status brought to the table's), with the full name and the client's."""
    return _latest_members(spark, sf).select("team_member_id", "id", "churn_probability", "risk_level",
                                             full_name("first_name", "last_name").alias("member_name"), "client_name")


def _latest_members(spark, sf):
    p = H.score_levels(A.predictions(spark, sf)).withColumnRenamed("client_id", "team_member_id")
    m = A.team_members(spark, sf).withColumn("status", F.lower("status"))
    return H.latest_member_predictions(p, m, A.clients(spark, sf))


@query("search_members", with_views(f"""
SELECT team_member_id, member_name, risk_level FROM ({_MEMBER_LATEST}) t
WHERE contains(lower(member_name), 'first1')""", "predictions", "team_members", "clients"))
def search_members(spark, sf):
    """Members whose name holds the term, whatever its case."""
    m = _latest_members(spark, sf).withColumn("member_name", full_name("first_name", "last_name"))
    return m.filter(F.lower("member_name").contains("FIRST1".lower())).select("team_member_id", "member_name", "risk_level")


@query("member_upsert", with_views(f"""
SELECT client_id AS team_member_id, prediction_day, id, churn_probability FROM daily""", "daily"))
def member_upsert(spark, sf):
    """A15 for members: two writes, one row per member and day."""
    from staywise.sources.store import member_store
    store = member_store(spark, _store_folder(spark, "members"))
    p = A.predictions(spark, sf).withColumnRenamed("client_id", "team_member_id")
    store.upsert(p.filter(F.col("id") % 2 != 0), "odd")
    store.upsert(p.filter(F.col("id") % 2 == 0), "even")
    return store.current().select("team_member_id", "prediction_day", "id", "churn_probability")


@query("model_checks", """
WITH y AS (SELECT CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS y FROM orders),
n AS (SELECT y, count(*) AS n FROM y GROUP BY y)
SELECT 12 AS features, CAST(1.0 AS DOUBLE) AS importance_sum,
       (SELECT CAST(sum(round(n * 0.8)) AS BIGINT) FROM n) AS train_rows,
       (SELECT CAST(sum(n - round(n * 0.8)) AS BIGINT) FROM n) AS test_rows,
       (SELECT count(*) FROM customer c WHERE c.c_custkey % 11 <> 0 AND
          (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c.c_custkey) >= TIMESTAMP '2000-08-01 00:00:00') AS scored_clients,
       0 AS wrong_levels, 0 AS wrong_scores, 0 AS wrong_margins, 0 AS wrong_means, 0 AS explained_otherwise""")
def model_checks(spark, sf):
    """Split sizes, importances, levels and scores
    recomputed from the stored probability, members recombined, contributions
    that do not add up to the margin (tolerance 1e-6)."""
    train, test = QM.churn_split(spark, sf)
    imp = MO.feature_importances(spark, QM.churn_model(spark, sf, train), FT.TRAINING_MATRIX_12)
    a = imp.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 9).alias("importance_sum"))
    sizes = [d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((train, "train_rows"), (test, "test_rows"))]
    folder = _store_folder(spark, "scored")
    QM.score_clients(spark, sf).write.parquet(folder)
    p = F.col("churn_probability")
    level = F.when(p >= 0.85, "critical").when(p >= 0.65, "high").when(p >= 0.4, "medium").otherwise("low")
    s = spark.read.parquet(folder).agg(
        F.count(F.lit(1)).alias("scored_clients"), F.count_if(level != F.col("risk_level")).alias("wrong_levels"),
        F.count_if(F.floor(p * 100) != F.col("risk_score")).alias("wrong_scores"))
    rows = QM.scoring_rows(spark, sf)
    margin = MO.margin(QM.churn_model(spark, sf).transform(rows)).select("client_id", "margin")
    told = QM._explained(spark, sf).groupBy("client_id").agg(F.sum("contribution").alias("told"))
    both = told.join(margin, "client_id")
    e = both.agg(F.count_if(F.abs(F.col("told") - F.col("margin")) > 1e-6).alias("explained_otherwise"))
    prob = spark.read.parquet(folder).select("client_id", "churn_probability").join(margin, "client_id")
    m = prob.agg(F.count_if(F.abs(1 / (1 + F.exp(-2 * F.col("margin"))) - p) > 1e-9).alias("wrong_margins"))
    cal = QM.calibrated_model(spark, sf, train)
    single = None
    for member in cal.members:
        part = MO.CalibratedModel([member]).transform(rows, out="q").select("client_id", "q")
        single = part if single is None else single.unionByName(part)
    mean = single.groupBy("client_id").agg(F.avg("q").alias("q"))
    c = cal.transform(rows, out="p").select("client_id", "p").join(mean, "client_id").agg(
        F.count_if((F.abs(F.col("p") - F.col("q")) > 1e-9) | ~F.col("p").between(0, 1)).alias("wrong_means"))
    return M._one_row_join(a, *sizes, s, m, c, e)


@query("sync_store", with_views(f"""
SELECT client_id, churn_probability, {score_sql('churn_probability')} AS risk_score,
       {level_sql('churn_probability', (0.25, 0.5, 0.75))} AS risk_level
FROM latest_cp WHERE client_id IN (SELECT id FROM clients WHERE is_active = true)""", "latest_cp"))
def sync_store(spark, sf):
    """A17 for real: the synced records written into the daily store, twice (the
    second run of a day replaces the first), and read back."""
    from staywise.operators import rules as R
    from staywise.plans.q_history import latest_cp
    from staywise.sources.store import DailyStore
    lat = latest_cp(spark, sf).select("client_id", "churn_probability")
    recs = R.sync_records(lat.join(QM.scoring_rows(spark, sf), "client_id", "inner"), "v1", A.AS_OF_PREDICTIONS)
    store = DailyStore(spark, _store_folder(spark, "sync"), tiebreak="model_version")
    store.upsert(recs.withColumn("churn_probability", F.lit(0.0)).withColumn("model_version", F.lit("v0")), "first")
    store.upsert(recs, "second")
    return store.current().select("client_id", "churn_probability", F.col("risk_score"), "risk_level")


@query("unmapped_timeframes", with_views("""
SELECT count(*) FILTER (WHERE replacement_timeframe <> '') AS filled,
       count(*) FILTER (WHERE replacement_timeframe = 'no rush') AS unmapped,
       count(*) FILTER (WHERE replacement_timeframe = 'no rush') / count(*) FILTER (WHERE replacement_timeframe <> '') AS share
FROM terminations""", "terminations"))
def unmapped_timeframes(spark, sf):
    """The share of timeframes that the urgency words do not know."""
    from staywise.operators.audit import unmapped_share
    return unmapped_share(A.terminations(spark, sf), "replacement_timeframe", ("Immediate", "1-2 weeks", "2-4 weeks"))


@query("ambiguous_dates", """
SELECT count(*) AS filled, count(*) FILTER (WHERE day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)) AS ambiguous FROM orders""")
def ambiguous_dates(spark, sf):
    """Order dates written month first, that also read day first."""
    from staywise.operators.audit import ambiguous_dates as count
    from staywise.sources.tables import table
    return count(table(spark, sf, "orders").select(F.date_format("o_orderdate", "M/d/yyyy").alias("d")), "d")


@query("constant_columns", with_views("""
SELECT 'termination_type_encoded' AS feature, CAST(0 AS DOUBLE) AS value
UNION ALL SELECT 'had_pip_at_least_zero', 1.0 WHERE (SELECT count(*) FROM terminations) > 0""", "terminations"))
def constant_columns(spark, sf):
    """The training features that never vary."""
    from staywise.operators.audit import constant_columns as const
    tm = FT.training_matrix(FT.training_data(A.terminations(spark, sf)))
    tm = tm.withColumn("had_pip_at_least_zero", (F.col("had_pip") >= 0).cast("int"))
    return const(tm, [*FT.TRAINING_MATRIX_12, "had_pip_at_least_zero"])


@query("label_leaks", with_views("""
SELECT 'is_active_flag' AS feature, count(DISTINCT coalesce(CAST(is_active AS VARCHAR), 'none')) AS "values" FROM clients
WHERE is_active IS NOT NULL""", "clients"))
def label_leaks(spark, sf):
    """Of the client features and the active flag, those that give the label away."""
    from staywise.operators.audit import leaks
    c = A.clients(spark, sf).filter(F.col("is_active").isNotNull())
    f = FT.client_features(c, A.AS_OF_ACCOUNTS).select("id", "tenure_months", "health_score", "industry_encoded")
    d = f.join(c.select("id", F.col("is_active").cast("int").alias("is_active_flag"), (~F.col("is_active")).cast("int").alias("y")), "id")
    return leaks(d, ["health_score", "industry_encoded", "is_active_flag"], "y")


@query("threshold_on_validation", with_views("""
SELECT * FROM (WITH s AS (SELECT k.id, k.y, x.p, CASE WHEN k.pos < round(k.n * 0.6) THEN 'train' WHEN k.pos < round(k.n * 0.8) THEN 'validation' ELSE 'test' END AS split
           FROM rk k JOIN scored x ON x.id = k.id),
g AS (SELECT unnest([0.40, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80])::DOUBLE AS t),
c AS (SELECT t, sum(CASE WHEN p >= t AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= t THEN 1 ELSE 0 END) AS fl, sum(y) AS pos
      FROM s, g WHERE split = 'validation' GROUP BY t),
f AS (SELECT t, CASE WHEN fl > 0 AND tp > 0 THEN 1.25 * (tp / fl) * (tp / pos) / (0.25 * (tp / fl) + tp / pos) ELSE 0 END AS f05 FROM c),
b AS (SELECT t FROM (SELECT t FROM f WHERE f05 > 0 ORDER BY f05 DESC, t LIMIT 1) UNION ALL SELECT 0.5 WHERE NOT EXISTS (SELECT 1 FROM f WHERE f05 > 0))
SELECT b.t AS threshold, count(*) FILTER (WHERE p < b.t AND y = 0) AS tn, count(*) FILTER (WHERE p >= b.t AND y = 0) AS fp,
       count(*) FILTER (WHERE p < b.t AND y = 1) AS fn, count(*) FILTER (WHERE p >= b.t AND y = 1) AS tp
FROM s, b WHERE split = 'test' GROUP BY b.t) t""", "scored", extra={"rk": SPLIT_RANK}))
def threshold_on_validation(spark, sf):
    """The threshold is chosen on the validation part, the confusion reported on the test part."""
    from staywise.operators.audit import three_way_split
    s = three_way_split(A.scored(spark, sf))
    best = M.best_threshold_grid(M.threshold_sweep(s.filter("split = 'validation'"))).first()["threshold"]
    c = M.confusion(s.filter("split = 'test'"), best)
    return c.select(F.lit(best).alias("threshold"), "tn", "fp", "fn", "tp")
