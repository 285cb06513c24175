"""Registered queries of the kept tables: imports with counts (A1, B4, C2) and
the last days of each entity (C3, C6, E1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from staywise.functions.values import full_name
from staywise.operators import features as FT
from staywise.operators import history as H
from staywise.plans.oracle_views import level_sql, with_views
from staywise.plans.q_features import FORM_FEATURES_SQL
from staywise.plans.q_history import latest_cp
from staywise.plans.q_io import FORM_EXPORT, _store_folder
from staywise.plans.q_round2 import _MEMBER_LATEST, _latest_members
from staywise.plans.registry import query
from staywise.operators import summary as S
from staywise.sources import adapters as A
from staywise.sources import ingest as I
from staywise.sources import store as ST
from staywise.sources.imports import TerminationTable
from staywise.sources.latest import LatestTable
from staywise.sources.membership import FeatureTable
from staywise.sources.search_index import SearchIndex
from staywise.sources.store import DailyStore, export_all

#: Form headers of the columns that the feature step reads beyond ``FORM_EXPORT``.
MORE_HEADERS = {
    "last_comm_date": "Last Date of General Communication With The Client",
    "last_checkin_date": "Last Date of Official Weekly/Bi-Monthly/Monthly Check In",
    "tm_last_date": "Last Date for Team Member",
    "client_start_date": "Client Start Date:",
    "replacement_timeframe": "Timeframe for Replacement",
}


def _imported(spark, sf) -> TerminationTable:
    """Form files of every termination row (each 17th without a client name):
    the even ids, these again with a third of the others, all; features after
    the first and the last.  An import reads all its files again, the ones
    before included; a row is in one of them, so each is written once."""
    table = TerminationTable(spark, _store_folder(spark, "imports"))
    t = A.terminations(spark, sf)
    name = F.when(F.col("id") % 17 == 0, F.lit("  ")).otherwise(F.col("client_name"))
    form = t.withColumn("client_name", name).select("id", *[F.col(c).cast("string").alias(h) for c, h in (FORM_EXPORT | MORE_HEADERS).items()],
                                                    F.col("id").cast("string").alias("Score"))
    files, source = _store_folder(spark, "form"), _store_folder(spark, "form-rows")
    piece = F.expr("CASE WHEN id % 2 = 0 THEN '0' WHEN id % 3 = 0 THEN '1' ELSE '2' END")
    form.withColumn("piece", piece).write.option("compression", "zstd").parquet(source)  # joined once, not by each count and file
    form = spark.read.parquet(source)
    for k in ("0", "1", "2"):
        export_all({k: form.where(F.col("piece") == k).drop("id", "piece")}, files, "csv")
        table.import_csv(f"{files}/{{{','.join('012'[:int(k) + 1])}}}")
        if k != "1":
            table.compute_features()
    return table


def _counts(k: int, now: str, before: str) -> str:
    return (f"SELECT CAST({k} AS BIGINT) AS import, count(*) FILTER (WHERE ({now})) AS total_rows, count(*) FILTER (WHERE ({now}) AND id % 17 = 0) AS dropped_rows, "
            f"count(*) FILTER (WHERE ({now}) AND NOT ({before}) AND id % 17 <> 0) AS appended_rows FROM terminations")


@query("form_import_counts", with_views(" UNION ALL ".join([
    _counts(0, "id % 2 = 0", "false"), _counts(1, "id % 2 = 0 OR id % 3 = 0", "id % 2 = 0"), _counts(2, "true", "id % 2 = 0 OR id % 3 = 0")]), "terminations"))
def form_import_counts(spark, sf):
    """Total, dropped and appended rows of three overlapping imports."""
    return _imported(spark, sf).imports().select(F.col("sequence").alias("import"), "total_rows", "dropped_rows", "appended_rows")


@query("imported_form_features", with_views(f"""
SELECT CAST(t.id AS VARCHAR) AS score, {', '.join(f'ff.{c}' for c in FT.FORM_FEATURE_COLUMNS)}
FROM terminations t JOIN ff ON ff.termination_id = t.id WHERE t.id % 17 <> 0""", "terminations", extra={"ff": FORM_FEATURES_SQL}))
def imported_form_features(spark, sf):
    """The features of every imported row, one row each after all imports."""
    table = _imported(spark, sf)
    return table.rows_with_features(["score"]).select("score", *FT.FORM_FEATURE_COLUMNS)


AT = "2024-01-20"


@query("latest_days_table", with_views(f"""
SELECT l.client_id, l.prediction_day, l.id, l.risk_level, p.prediction_day AS previous_day, p.risk_level AS previous_level FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY prediction_day DESC) AS k FROM one) l
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY prediction_day DESC) AS k FROM one WHERE prediction_day < DATE '{AT}') p
  ON p.client_id = l.client_id AND p.k = 1 WHERE l.k = 1""", "predictions", extra={"one": f"""
  SELECT client_id, id, CAST(prediction_date AS DATE) AS prediction_day, {level_sql('churn_probability')} AS risk_level FROM (
    SELECT *, row_number() OVER (PARTITION BY client_id, CAST(prediction_date AS DATE) ORDER BY prediction_date DESC, id DESC) AS k FROM predictions
    WHERE client_id IS NOT NULL) WHERE k = 1"""}))
def latest_days_table(spark, sf):
    """All predictions stored in four batches whose days come out of
    order, one batch twice; each client's latest day and last level before
    ``AT`` from the kept days."""
    store = DailyStore(spark, _store_folder(spark, "days"))
    table = LatestTable(store)
    preds = H.score_levels(A.predictions(spark, sf))
    part = F.pmod(F.datediff(F.to_date("prediction_date"), F.lit("2024-01-01").cast("date")), F.lit(4))
    for k in (2, 0, 3, 0, 1):
        store.upsert(preds.where(part == k), str(k))
        if k != 3:
            table.refresh()
    latest = table.latest().select("client_id", "prediction_day", "id", "risk_level")
    return table.previous_level(latest, AT).select("client_id", "prediction_day", "id", "risk_level", "previous_day", "previous_level")


@query("stable_codes", with_views("""
SELECT v AS value, row_number() OVER (ORDER BY later, v) - 1 AS code FROM (
  SELECT DISTINCT coalesce(geo_location, 'Unknown') AS v, CASE WHEN geo_location > 'J' THEN 0 ELSE 1 END AS later FROM terminations)""", "terminations"))
def stable_codes(spark, sf):
    """The codes of the locations after two fits, the second of which
    sees values that sort before the first one's."""
    from staywise.operators.dictionary import Dictionary
    t = A.terminations(spark, sf)
    d = Dictionary(spark, _store_folder(spark, "dictionary"))
    for rows in (t.where("geo_location > 'J'"), t, t):
        d.extend(rows, {"geo_location": "Unknown"})
    return d.vocabulary("geo_location")


@query("dashboard_overview", with_views("""
SELECT clients, critical_clients, high_clients, medium_clients, low_clients,
       round(critical_clients * 100.0::DOUBLE / clients, 4) AS critical_percent, round(high_clients * 100.0::DOUBLE / clients, 4) AS high_percent,
       round(medium_clients * 100.0::DOUBLE / clients, 4) AS medium_percent, round(low_clients * 100.0::DOUBLE / clients, 4) AS low_percent,
       members, members_at_risk
FROM (SELECT count(*) AS clients, count(*) FILTER (WHERE risk_level = 'critical') AS critical_clients, count(*) FILTER (WHERE risk_level = 'high') AS high_clients,
             count(*) FILTER (WHERE risk_level = 'medium') AS medium_clients, count(*) FILTER (WHERE risk_level = 'low') AS low_clients FROM latest_cp),
     (SELECT count(*) AS members, count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS members_at_risk FROM lm)""",
                                    "latest_cp", "predictions", "team_members", extra={"lm": f"""
  SELECT {level_sql('s.churn_probability')} AS risk_level
  FROM (SELECT p.*, row_number() OVER (PARTITION BY client_id ORDER BY prediction_date DESC, id DESC) AS rn FROM predictions p) s
  JOIN team_members m ON m.id = s.client_id WHERE s.rn = 1 AND m.status = 'Active'"""}))
def dashboard_overview(spark, sf):
    """The clients' levels with their shares, and the members' card."""
    from staywise.plans.q_history import latest_cp
    from staywise.plans.q_round2 import _latest_members
    return S.dashboard_overview(latest_cp(spark, sf), _latest_members(spark, sf))


@query("training_files", with_views("""
SELECT 'client' AS kind, id, status, CAST(start_date AS TIMESTAMP) AS start_date, CAST(updated_at AS TIMESTAMP) AS updated_at, CAST(is_active AS VARCHAR) AS flag FROM clients
UNION ALL SELECT 'member', id, status, CAST(start_date AS TIMESTAMP), CAST(updated_at AS TIMESTAMP), CAST(client_id AS VARCHAR) FROM team_members""", "clients", "team_members"))
def training_files(spark, sf):
    """A5: all clients and members written as the two training files and loaded back with their types."""
    folder = _store_folder(spark, "training")
    for name, df in (("clients", A.clients(spark, sf)), ("team_members", A.team_members(spark, sf))):
        df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.option("header", True).csv(f"{folder}/{name}.csv")
    clients, members = I.load_training_files(spark, folder)
    cols = ["id", "status", "start_date", "updated_at"]
    return clients.select(F.lit("client").alias("kind"), *cols, F.col("is_active").cast("string").alias("flag")).unionByName(
        members.select(F.lit("member").alias("kind"), *cols, F.col("client_id").cast("string").alias("flag")))


@query("prediction_files", with_views("""
SELECT client_id, round(churn_probability, 9) AS churn_probability, risk_level FROM latest_cp""", "latest_cp"))
def prediction_files(spark, sf):
    """Each client's latest prediction exported as sorted files of two
    instants, the older one later and with other values; the newest read back."""
    from staywise.plans.q_history import latest_cp
    folder = _store_folder(spark, "exports")
    rows = latest_cp(spark, sf).select("client_id", "churn_probability", "risk_level")
    ST.export_predictions(rows, folder, "2024-01-31 06:00:00")
    ST.export_predictions(rows.withColumn("churn_probability", F.lit(0.0)), folder, "2024-01-30 06:00:00")
    back = ST.latest_predictions(spark, folder)
    return back.select(F.col("client_id").cast("long").alias("client_id"), F.round(F.col("churn_probability").cast("double"), 9).alias("churn_probability"), "risk_level")


#: Terms of every kind: found, in digits, in both fields, in too many names, too short, nowhere.
SEARCH_TERMS = (("bUiLd", "medium"), ("00000012", "all"), ("URN", "all"), ("mer#000", "high"), ("9", "critical"), ("zzzq", "all"))


def _search_sql(source: str, columns: str, fields, terms) -> str:
    def one(term, level):
        hit = " OR ".join(f"contains(lower({f}), '{term.lower()}')" for f in fields)
        return f"SELECT '{term}' AS term, {columns} FROM {source} WHERE ({hit})" + ("" if level == "all" else f" AND risk_level = '{level}'")
    return " UNION ALL ".join(one(*t) for t in terms)


def _all_terms(index, rows, terms, *columns):
    out = None
    for term, level in terms:
        d = index.search(rows, term, level).select(F.lit(term).alias("term"), *columns)
        out = d if out is None else out.unionByName(d)
    return out


@query("search_clients_index", with_views(_search_sql(
    "latest_cp", "client_id, client_name, industry_type, risk_level", ("client_name", "industry_type"), SEARCH_TERMS), "latest_cp"))
def search_clients_index(spark, sf):
    """B7 by postings: names and industries indexed in two refreshes, then every term."""
    rows = latest_cp(spark, sf)
    index = SearchIndex(spark, _store_folder(spark, "search"))
    index.refresh(rows.where("client_id % 2 = 0"))
    index.refresh(rows)
    return _all_terms(index, rows, SEARCH_TERMS, "client_id", "client_name", "industry_type", "risk_level")


MEMBER_TERMS = (("FIRST1", "all"), ("st1 l", "low"), ("00000012", "all"), ("1", "critical"), ("nobody", "all"))


@query("search_members_index", with_views(_search_sql(
    f"({_MEMBER_LATEST}) m", "team_member_id, member_name, client_name", ("member_name", "client_name"), MEMBER_TERMS),
    "predictions", "team_members", "clients"))
def search_members_index(spark, sf):
    """B8 by postings: the member's or the client's name holds the term."""
    rows = _latest_members(spark, sf).withColumn("member_name", full_name("first_name", "last_name"))
    index = SearchIndex(spark, _store_folder(spark, "search-members"), "team_member_id", ("member_name", "client_name"))
    index.refresh(rows)
    return _all_terms(index, rows, MEMBER_TERMS, "team_member_id", "member_name", "client_name")


def _appended(k: int, now: str, before: str) -> str:
    return (f"SELECT CAST({k} AS BIGINT) AS append, count(*) AS n_rows, count(*) FILTER (WHERE {before}) AS n_stored, "
            f"count(*) FILTER (WHERE NOT ({before})) AS n_written FROM terminations WHERE {now}")


@query("feature_appends", with_views(" UNION ALL ".join([
    _appended(0, "id % 2 = 0", "false"), _appended(1, "id % 3 = 0", "id % 2 = 0"), _appended(2, "true", "id % 2 = 0 OR id % 3 = 0"),
    _appended(3, "true", "true")]), "terminations"))
def feature_appends(spark, sf):
    """C2/L2 by month filters: features of all rows in four overlapping appends;
    how many of each were stored already and how many were written."""
    t = A.terminations(spark, sf)
    table = FeatureTable(spark, _store_folder(spark, "months"))
    month = F.coalesce(F.date_format(F.col("notice_date"), "yyyy-MM"), F.lit("none"))
    done = []
    for k, some in enumerate(("id % 2 = 0", "id % 3 = 0", "true", "true")):
        n = table.append(FT.form_features(t.where(some), {"notice_month": month}))
        done.append((k, n["rows"], n["stored"], n["written"]))
    return spark.createDataFrame(done, "append long, n_rows long, n_stored long, n_written long")
