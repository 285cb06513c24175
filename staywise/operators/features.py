"""Feature pipelines.

Each pipeline is one projection over the input (plus vocabulary joins for
encoded columns), so the whole feature row is computed inside one codegen
stage per partition.  ``as_of`` is always a parameter, never the clock.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.dates import (days_between, month_or, parse_date, quarter_or, tenure_months,
                                      ts_literal, weekday_or, whole_days)
from staywise.functions.risk import tenure_bucket
from staywise.functions.values import clip, first_contains, map_value, parse_boolean, to_number, yes_flag
from staywise.operators.encode import factorize, fit_vocabularies, fit_vocabulary, label_encode, vocabulary

# Encoding profiles (trap T2: the same names are encoded
# differently by different parts of the system; each profile is kept whole).
FORM_HEALTH = {"excellent": 4, "good": 3, "fair": 2, "poor": 1}                 # default 0
FORM_CADENCE = {"weekly": 1, "bi-weekly": 2, "bi-monthly": 2, "monthly": 3}    # default 4
FORM_URGENCY = (("immediate", 3), ("asap", 3), ("1-2 weeks", 2), ("2-4 weeks", 1), ("1 week", 2))  # default 0
V2_REPLACEMENT = {"Yes": 1.0, "No": 0.0, "TBA": 0.5}                            # default 0.5
V2_CADENCE = {"Daily": 4, "Weekly": 3, "Bi-Monthly": 2, "Monthly": 1}           # default 2
CLIENT_HEALTH = {"excellent": 4, "good": 3, "fair": 2, "poor": 1, "unknown": 2}  # default 2

TRAINING_MATRIX_12 = ("days_since_communication", "days_since_checkin", "health_score",
                      "checkin_frequency_encoded", "no_replacement", "replacement_urgency", "had_pip",
                      "offered_discount", "current_seat_count", "client_tenure_at_termination",
                      "termination_type_encoded", "geo_encoded")
FORM_V2_13 = ("no_replacement", "current_seat_count", "health_score", "checkin_frequency",
              "termination_type_encoded", "days_since_checkin", "days_since_communication",
              "client_tenure_months", "tm_tenure_months", "had_pip", "offered_discount", "geo_encoded",
              "replacement_urgency")
FORM_V2_9 = tuple(c for c in FORM_V2_13 if c not in ("had_pip", "offered_discount", "geo_encoded",
                                                       "replacement_urgency"))
CLIENT_FEATURES = ("tenure_months", "health_score", "days_since_activity", "industry_encoded",
                   "location_encoded", "is_active", "start_month", "start_quarter", "days_since_start")
MEMBER_FEATURES = ("tenure_months", "role_encoded", "days_since_activity", "has_client", "tenure_bucket",
                   "is_new_employee", "start_month", "start_day_of_week")


def _as_date(df: DataFrame, c: str):
    """A date from a stored value: text goes through the form's date parser
    (H1); typed dates/timestamps only lose their time of day."""
    dtype = dict(df.dtypes)[c]
    return parse_date(F.col(c)) if dtype == "string" else F.to_date(F.col(c))


FORM_DATES = ("notice_date", "last_comm_date", "last_checkin_date", "tm_start_date", "tm_last_date",
              "client_start_date")


FORM_FEATURE_COLUMNS = ("days_since_communication", "days_since_checkin", "team_member_tenure_days",
                        "client_tenure_at_termination", "health_score", "checkin_frequency_encoded",
                        "no_replacement", "replacement_urgency", "had_pip", "offered_discount")


def form_features(terms: DataFrame, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """The ten computed features of a termination row (id kept, plus the
    ``keep`` Columns, by output name, carried through the same projection).
    Dates are parsed and texts lower-cased once in a first projection; conditional
    expressions are not subexpression-eliminated, so parsing inside each
    difference, or lower-casing inside each comparison, would repeat it."""
    keep = dict(keep or {})
    lowered = {"health_text": "none", "check_in_cadence": "none", "replacement_timeframe": ""}
    dated = terms.select("id", "will_have_replacement", "pip_implemented", "relief_offered",
                         *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(v))).alias(c) for c, v in lowered.items()],
                         *[_as_date(terms, c).alias(c) for c in FORM_DATES],
                         *[c.alias(f"__k_{n}") for n, c in keep.items()])
    notice, comm, checkin = F.col("notice_date"), F.col("last_comm_date"), F.col("last_checkin_date")
    tm_start, tm_last, c_start = F.col("tm_start_date"), F.col("tm_last_date"), F.col("client_start_date")
    return dated.select(
        F.col("id").alias("termination_id"),
        F.coalesce(whole_days(comm, notice), F.lit(999)).alias("days_since_communication"),
        F.coalesce(whole_days(checkin, notice), F.lit(999)).alias("days_since_checkin"),
        F.coalesce(whole_days(tm_start, tm_last), F.lit(0)).alias("team_member_tenure_days"),
        F.coalesce(whole_days(c_start, notice), F.lit(0)).alias("client_tenure_at_termination"),
        map_value("health_text", FORM_HEALTH, 0).alias("health_score"),
        map_value("check_in_cadence", FORM_CADENCE, 4).alias("checkin_frequency_encoded"),
        (1 - parse_boolean("will_have_replacement")).alias("no_replacement"),
        first_contains("replacement_timeframe", FORM_URGENCY, 0, lower=False).alias("replacement_urgency"),
        parse_boolean("pip_implemented").alias("had_pip"),
        parse_boolean("relief_offered").alias("offered_discount"),
        *[F.col(f"__k_{n}").alias(n) for n in keep],
    )


def form_features_v2(labeled: DataFrame, keep: int = 13, label_col: str = "churned") -> DataFrame:
    """The 13- (or 9-) column profile over labelled form rows; the three
    encoders are fitted on the same rows."""
    notice = F.col("notice_date")
    df = labeled.select(
        "id", label_col, "termination_reason", "geo_location", "replacement_timeframe",
        (1 - map_value("will_have_replacement", V2_REPLACEMENT, 0.5)).alias("no_replacement"),
        clip(to_number("seat_count") if dict(labeled.dtypes)["seat_count"] == "string"
             else F.col("seat_count").cast("double"), 0.0, 50.0, 1.0).alias("current_seat_count"),
        F.coalesce(to_number("health_text"), F.lit(3.0)).alias("health_score"),
        map_value("check_in_cadence", V2_CADENCE, 2).alias("checkin_frequency"),
        clip(days_between("last_checkin_date", notice), 0, 180, 14).alias("days_since_checkin"),
        clip(days_between("last_comm_date", notice), 0, 180, 14).alias("days_since_communication"),
        clip(days_between("client_start_date", notice) / 30.0, 0.0, 120.0, 12.0).alias("client_tenure_months"),
        clip(days_between("tm_start_date", notice) / 30.0, 0.0, 60.0, 6.0).alias("tm_tenure_months"),
        yes_flag("pip_implemented").alias("had_pip"),
        yes_flag("relief_offered").alias("offered_discount"),
    )
    enc = [(src, out) for src, out in (("termination_reason", "termination_type_encoded"),
                                       ("geo_location", "geo_encoded"),
                                       ("replacement_timeframe", "replacement_urgency"))
           if not (keep == 9 and out in ("geo_encoded", "replacement_urgency"))]
    vocabs = fit_vocabularies(df, {src: "Unknown" for src, _ in enc})
    for src, out in enc:
        df = label_encode(df, src, vocabulary(vocabs, src), out, "Unknown")
    cols = FORM_V2_13 if keep == 13 else FORM_V2_9
    return df.select("id", *cols, label_col)


def client_features(clients: DataFrame, as_of: str, industry_vocab: DataFrame | None = None,
                    location_vocab: DataFrame | None = None) -> DataFrame:
    """Nine client features.  Vocabularies are fitted on the input unless
    stored ones are passed (scoring), in which case unseen values map to
    OTHER / Unknown (H19)."""
    ref = ts_literal(as_of)
    start = F.coalesce(F.col("start_date"), F.col("created_at"))
    df = clients.select(
        "id", "industry_type", "client_location",
        tenure_months(days_between(start, ref)).alias("tenure_months"),
        map_value(F.coalesce(F.col("health"), F.lit("unknown")), CLIENT_HEALTH, 2, lower=True).alias("health_score"),
        clip(days_between("updated_at", ref), 0, 365, 30).alias("days_since_activity"),
        F.coalesce(F.col("is_active"), F.lit(True)).cast("int").alias("is_active"),
        month_or(start).alias("start_month"),
        quarter_or(start).alias("start_quarter"),
        clip(days_between(start, ref), 0, 3650, 0).alias("days_since_start"),
    )
    if industry_vocab is None or location_vocab is None:
        vocabs = fit_vocabularies(df, {"industry_type": "OTHER", "client_location": "Unknown"})
    iv = industry_vocab if industry_vocab is not None else vocabulary(vocabs, "industry_type")
    lv = location_vocab if location_vocab is not None else vocabulary(vocabs, "client_location")
    stored = industry_vocab is not None
    df = label_encode(df, "industry_type", iv, "industry_encoded", "OTHER", unseen="OTHER" if stored else None)
    df = label_encode(df, "client_location", lv, "location_encoded", "Unknown", unseen="Unknown" if stored else None)
    return df.select("id", *CLIENT_FEATURES)


def member_features(members: DataFrame, as_of: str, role_vocab: DataFrame | None = None) -> DataFrame:
    """Eight member features; months outside the bucket edges give a null
    bucket (quarantined by the caller) instead of failing."""
    ref = ts_literal(as_of)
    start = F.coalesce(F.col("start_date"), F.col("created_at"))
    tm = tenure_months(days_between(start, ref))
    df = members.select(
        "id", "role",
        tm.alias("tenure_months"),
        clip(days_between("updated_at", ref), 0, 365, 7).alias("days_since_activity"),
        F.col("client_id").isNotNull().cast("int").alias("has_client"),
        tenure_bucket(tm).alias("tenure_bucket"),
        (tm <= 3).cast("int").alias("is_new_employee"),
        month_or(start).alias("start_month"),
        weekday_or(start).alias("start_day_of_week"),
    )
    rv = role_vocab if role_vocab is not None else fit_vocabulary(df, "role", "team_member")
    df = label_encode(df, "role", rv, "role_encoded", "team_member",
                      unseen="team_member" if role_vocab is not None else None)
    return df.select("id", *MEMBER_FEATURES)


def simple_client_features(clients: DataFrame, as_of: str) -> DataFrame:
    """J8 (clients): five columns, categories coded by first appearance."""
    ref = ts_literal(as_of)
    start = F.coalesce(F.col("start_date"), F.col("created_at"))
    df = clients.select(
        "id", "industry_type", "client_location",
        tenure_months(days_between(start, ref)).alias("tenure_months"),
        map_value(F.col("health"), {k: v for k, v in CLIENT_HEALTH.items() if k != "unknown"}, 2, lower=True)
        .alias("health_score"),
        clip(days_between("updated_at", ref), 0, 365, 30).alias("days_since_activity"),
    )
    df = factorize(df, "industry_type", "industry_encoded", "id", "OTHER")
    df = factorize(df, "client_location", "location_encoded", "id", "Unknown")
    return df.select("id", "tenure_months", "health_score", "days_since_activity", "industry_encoded",
                     "location_encoded")


def simple_member_features(members: DataFrame, as_of: str) -> DataFrame:
    """J8 (members): five columns."""
    ref = ts_literal(as_of)
    start = F.coalesce(F.col("start_date"), F.col("created_at"))
    tm = tenure_months(days_between(start, ref))
    df = members.select(
        "id", "role",
        tm.alias("tenure_months"),
        clip(days_between("updated_at", ref), 0, 365, 7).alias("days_since_activity"),
        F.col("client_id").isNotNull().cast("int").alias("has_client"),
        (tm <= 3).cast("int").alias("is_new_employee"),
    )
    df = factorize(df, "role", "role_encoded", "id", "team_member")
    return df.select("id", "tenure_months", "role_encoded", "days_since_activity", "has_client", "is_new_employee")


def training_data(terms: DataFrame, feats: DataFrame | None = None) -> DataFrame:
    """Terminations with their computed features, rows with a notice
    date only, label ``coalesce(client_lost, 0)`` (parsed boolean).

    Without a stored feature table the features are computed in the same
    projection as the carried columns - the join of a table with its own
    per-row projection would compute the input twice.  With a stored table
    (``feats``, e.g. the incremental table of L2) it is an inner join on id."""
    carried = {
        "client_name": F.col("client_name"), "notice_date": F.col("notice_date"),
        "termination_reason": F.col("termination_reason"), "geo_location": F.col("geo_location"),
        "client_lost": F.coalesce(parse_boolean("client_lost"), F.lit(0)),
        "current_seat_count": F.col("seat_count"),
    }
    if "termination_type" in terms.columns:  # not part of every form export
        carried["termination_type"] = F.col("termination_type")
    t = terms.filter(F.col("notice_date").isNotNull())
    if feats is None:
        f = form_features(t, carried).withColumnRenamed("termination_id", "id")
        return f.select("id", *carried, *FORM_FEATURE_COLUMNS)
    base = t.select("id", *[c.alias(n) for n, c in carried.items()])
    return base.join(feats.withColumnRenamed("termination_id", "id"), "id", "inner")


def pending_features(terms: DataFrame, feats: DataFrame) -> DataFrame:
    """Terminations that have no computed features yet (anti join)."""
    return terms.join(feats.select(F.col("termination_id").alias("id")), "id", "left_anti")


#: Encoded columns of the training matrix, with what stands for null.
MATRIX_VOCABULARIES = {"geo_location": "Unknown", "termination_type": "Unknown"}


def training_matrix(train: DataFrame, vocabs: DataFrame | None = None) -> DataFrame:
    """The 12-column training matrix.  Numeric coercion fills 0 first
    (so the later 999 / 1 defaults never apply - trap T4, kept as is),
    then the 999 clip; two label encodings, by the stored codes ``vocabs``
    (column, value, code; see ``dictionary.Dictionary``) or fitted on these rows."""
    num = ("days_since_communication", "days_since_checkin", "health_score", "checkin_frequency_encoded",
           "no_replacement", "replacement_urgency", "had_pip", "offered_discount", "current_seat_count",
           "client_tenure_at_termination", "client_lost")
    dtypes = dict(train.dtypes)

    def numeric(c):  # text goes through the coercing parser; numbers are only widened
        return to_number(c) if dtypes[c] == "string" else F.col(c).cast("double")
    has_type = "termination_type" in train.columns
    df = train.select("id", "client_name", "notice_date", "geo_location",
                      *(["termination_type"] if has_type else []),
                      *[F.coalesce(numeric(c), F.lit(0.0)).alias(c) for c in num])
    df = (df.withColumn("days_since_communication", clip("days_since_communication", 0.0, 999.0))
            .withColumn("days_since_checkin", clip("days_since_checkin", 0.0, 999.0)))
    if vocabs is None:
        vocabs = fit_vocabularies(df, {c: v for c, v in MATRIX_VOCABULARIES.items() if c in df.columns})
    if has_type:
        df = label_encode(df, "termination_type", vocabulary(vocabs, "termination_type"),
                          "termination_type_encoded", "Unknown")
    else:  # no termination type in the input: encoded as 0, as the training script does
        df = df.withColumn("termination_type_encoded", F.lit(0))
    df = label_encode(df, "geo_location", vocabulary(vocabs, "geo_location"), "geo_encoded", "Unknown")
    return df.select("id", "client_name", "notice_date", *TRAINING_MATRIX_12, "client_lost")


def scoring_matrix(active_clients: DataFrame, train_matrix: DataFrame) -> DataFrame:
    """Features for active clients from their last training row matched
    by lower-cased name (last = greatest (notice_date, id)), else health-based
    defaults.  History is reduced to one row per name by partial aggregation
    before the join; no per-client rescans."""
    from staywise.operators.history import latest
    hist = train_matrix.withColumn("name_key", F.lower(F.col("client_name")))
    last = latest(hist.filter(F.col("name_key").isNotNull()), "name_key", ("notice_date", "id")).select(
        "name_key",
        F.col("days_since_communication").alias("h_comm"), F.col("days_since_checkin").alias("h_checkin"),
        F.col("checkin_frequency_encoded").alias("h_freq"), F.col("current_seat_count").alias("h_seats"),
        F.lit(True).alias("h_found"))
    c = active_clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"), "health",
                              F.lower(F.col("name")).alias("name_key"))
    j = c.join(last, "name_key", "left")
    health = map_value(F.coalesce(F.col("health"), F.lit("none")), FORM_HEALTH, 2, lower=True)
    found = F.coalesce(F.col("h_found"), F.lit(False))
    seats = F.coalesce(F.col("h_seats"), F.lit(1.0))
    return j.select(
        "client_id", "client_name",
        F.when(found, F.col("h_comm")).when(health >= 3, 14.0).otherwise(30.0).alias("days_since_communication"),
        F.when(found, F.col("h_checkin")).when(health >= 3, 7.0).otherwise(21.0).alias("days_since_checkin"),
        health.cast("double").alias("health_score"),
        F.when(found, F.col("h_freq")).otherwise(2.0).alias("checkin_frequency_encoded"),
        F.lit(0.0).alias("no_replacement"), F.lit(0.0).alias("replacement_urgency"),
        F.lit(0.0).alias("had_pip"), F.lit(0.0).alias("offered_discount"),
        F.when(found, F.when(seats == 0, 1.0).otherwise(seats.cast("int").cast("double")))
        .otherwise(1.0).alias("current_seat_count"),
        F.lit(365.0).alias("client_tenure_at_termination"),
        F.lit(0.0).alias("termination_type_encoded"), F.lit(0.0).alias("geo_encoded"),
    )


def align_features(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Missing model columns added as 0, columns in model order."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else F.lit(0).alias(c) for c in expected])


def drop_zero_importance(df: DataFrame, names: Sequence[str] = ("health_score",)) -> DataFrame:
    """B11."""
    return df.drop(*[n for n in names if n in df.columns])
