"""Ingest: CSV form import, labelled loads, source union and scans
(A1-A9, A11, B1, B4, G1-G3, H9, H10).

CSV is always read with every column as string (no schema inference, which
would need an extra pass over the data and guesses types per file) and typed
afterwards with ``try_cast``-style Columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.functions.values import parse_boolean

# Form header -> table column (58 headers; two targets have two
# source spellings each, see ``normalise_headers``).
FORM_HEADER_MAP: dict[str, str] = {
    "Timestamp": "form_timestamp",
    "Client Success Partner": "client_success_partner",
    "Email Address": "csp_email",
    "Client Name": "client_name",
    "Name of Client Terminating": "terminating_entity_name",
    "Date of Receiving Termination/Replacement/Resignation Notice": "termination_notice_date",
    "Reason for Termination": "termination_reason",
    "Last Date for Team Member": "team_member_last_date",
    "Last Date of General Communication With The Client": "last_general_communication_date",
    "Cadence of Check Ins With The Client": "check_in_cadence",
    "Last Date of Official Weekly/Bi-Monthly/Monthly Check In": "last_official_checkin_date",
    "Will There Be A Replacement": "will_have_replacement",
    "Other Please Specify": "other_specify",
    "Specify the Client Health In The Last Month": "client_health_last_month",
    "Sales Person": "sales_person",
    "Team Member Re-Hirable Status": "team_member_rehirable_status",
    "Departments Notified [Finance]": "notified_finance",
    "Departments Notified [Team Experience]": "notified_team_experience",
    "Departments Notified [Talent Acquistion]": "notified_talent_acquisition",
    "Departments Notified [GTS]": "notified_gts",
    "Staff Sign Off Names (Confirmation By Staff Member)": "staff_sign_off_names",
    "Additional Comments or Reason For Termination/Resignation/Replacement": "additional_comments",
    "Score": "score",
    "Departments Notified [Client Solutions]": "notified_client_solutions",
    "Team Member Skillset": "team_member_skillset",
    "PMS & Applications Team Member is Familiar With?": "team_member_pms_applications",
    "Team Member Workstation Number": "team_member_workstation",
    "Reasons/Concerns for Re-Hirable Status": "rehirable_concerns",
    "Team Member Name": "team_member_name",
    "Client Requested to Interview Replacement": "client_requested_interview",
    "Timeframe for Replacement": "replacement_timeframe",
    "Client Time Zone & Working Hours": "client_timezone",
    "Team Member Position": "team_member_position",
    "Termination/Resignation Type": "termination_type",
    "In the case of Immediate Termination/Resignation was an SME seated until replacement is found?": "sme_seated_until_replacement",
    "Requested Replacements Name(s) for TA:": "requested_replacement_names",
    "Has Client Been Informed?": "client_informed",
    "Departments Notified [RCM]": "notified_rcm",
    "If Temporary Replacement Specify Time Period": "temporary_replacement_period",
    "Geo - Location": "geo_location",
    "Was a Performance Improvement Plan Implemented?": "pip_implemented",
    "Please share the Performance Improvement Plan Link below": "pip_link",
    "Business Issue Termination - Was the relief package/discounts offered?": "relief_package_offered",
    "Team Member  Start Date": "team_member_start_date",
    "Client Start Date:": "client_start_date",
    'If answered "yes" what was offered?': "relief_package_details",
    "If no longer replacing, explain below:": "no_longer_replacing_reason",
    "Current Client Seat Count": "current_seat_count",
    "Insert Files for any Additional Documentation Here:": "documentation_files",
    "If Selected Other, Please Specify": "other_specify",
    "Team Member Email": "team_member_email",
    "Team Member Phone Number": "team_member_phone",
    "Have we lost the Client?": "client_lost",
    "Which geo location(s) does the team member have experience working in?": "team_member_geo_experience",
    "If Selected Project Based seat, Please specify start and end date of project.": "project_based_dates",
    "RCM Seat?": "rcm_seat",
    "BYOD(Bring your own device) Access?": "byod_access",
    "Time Frame for Replacement": "replacement_timeframe",
}

# Columns parsed as 0/1 booleans on import.
FORM_BOOLEAN_COLUMNS = (
    "will_have_replacement", "client_requested_interview", "client_lost",
    "pip_implemented", "relief_package_offered", "client_informed",
    "notified_finance", "notified_team_experience", "notified_talent_acquisition",
    "notified_gts", "notified_client_solutions", "notified_rcm",
    "rcm_seat", "byod_access", "sme_seated_until_replacement",
)

TERMINATION_COLUMNS = tuple(dict.fromkeys(FORM_HEADER_MAP.values()))


def _norm(h: str) -> str:
    """Header normal form: trimmed, inner blank runs collapsed (trap T15)."""
    return re.sub(r"\s+", " ", h.strip())


def read_csv_strings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every column as string; a missing path fails (no sample fallback).
    ``multi_line`` admits line ends inside quoted fields, which a file can only
    be read whole for (one task per file); without it a file is split."""
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("multiLine", multi_line).option("escape", '"').csv(path))


#: Columns of the client and member files that training reads, with their types.
CLIENT_FILE = {"id": "bigint", "name": "string", "industry_type": "string", "client_location": "string", "start_date": "timestamp_ntz",
               "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz", "health": "string", "status": "string", "is_active": "boolean",
               "attrition_date": "timestamp_ntz"}
MEMBER_FILE = {"id": "bigint", "first_name": "string", "last_name": "string", "role": "string", "status": "string",
               "start_date": "timestamp_ntz", "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz", "client_id": "bigint"}


def read_typed_csv(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """A5: a file with a header row as typed columns: read as text, matched by
    trimmed header, cast without failing (text that is no such value is null).
    Columns that the file lacks are null, others are left out; a missing file
    is an error, not a sample."""
    raw = read_csv_strings(spark, path)
    have = {_norm(c): c for c in raw.columns}
    return raw.select(*[(F.trim(F.col(f"`{have[c]}`")).try_cast(t) if t != "string" else F.col(f"`{have[c]}`")).alias(c)
                        if c in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def load_training_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A5: (clients, members) of the two files that the training script takes."""
    base = folder.rstrip("/")
    return read_typed_csv(spark, f"{base}/clients.csv", CLIENT_FILE), read_typed_csv(spark, f"{base}/team_members.csv", MEMBER_FILE)


def normalise_headers(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """A1/A2: rename through ``mapping`` (matched on normalised headers); two
    source headers for one target are merged with ``coalesce`` instead of
    producing duplicate columns.  Unmapped headers are dropped."""
    by_norm = {_norm(k): v for k, v in mapping.items()}
    targets: dict[str, list[str]] = {}
    for c in df.columns:
        t = by_norm.get(_norm(c))
        if t is not None:
            targets.setdefault(t, []).append(c)
    cols = []
    for t, srcs in targets.items():
        exprs = [F.col(f"`{s}`") for s in srcs]
        if len(exprs) > 1:  # a blank spelling does not hide a filled one
            exprs = [F.coalesce(*[F.when(F.trim(e) != "", e) for e in exprs])]
        cols.append(exprs[0].alias(t))
    return df.select(*cols)


def import_terminations(spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None,
                        multi_line: bool = False) -> DataFrame:
    """A1: form CSV -> termination rows (a custom map replaces the default),
    booleans parsed to 0/1, rows with a blank client name dropped."""
    df = normalise_headers(read_csv_strings(spark, path, multi_line), mapping or FORM_HEADER_MAP)
    df = df.select(*[parse_boolean(c).alias(c) if c in FORM_BOOLEAN_COLUMNS else F.col(c)
                     for c in df.columns])
    if "client_name" in df.columns:
        df = non_blank(df, "client_name")
    return df


def non_blank(df: DataFrame, col: str) -> DataFrame:
    """Not null and not empty after trim."""
    return df.filter(F.col(col).isNotNull() & (F.trim(F.col(col)) != ""))


def label_outcome(df: DataFrame, col: str, out: str = "churned") -> DataFrame:
    """B1: 'Yes' -> 1, 'No' -> 0, anything else null (unlabelled)."""
    return df.withColumn(out, F.when(F.col(col) == "Yes", 1).when(F.col(col) == "No", 0))


def load_labeled(df: DataFrame, col: str = "client_lost", out: str = "churned") -> DataFrame:
    """A3: label and keep labelled rows only."""
    return label_outcome(df, col, out).filter(F.col(out).isNotNull())


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Intersection of column names (sorted, as the loader does)."""
    return sorted(set(a.columns) & set(b.columns))


def load_combined(real: DataFrame, synthetic: DataFrame, label_col: str = "client_lost",
                  out: str = "churned") -> DataFrame:
    """Common columns, tagged with ``_source``, united, labelled, filtered."""
    cols = common_columns(real, synthetic)
    u = (real.select(*cols).withColumn("_source", F.lit("real"))
         .unionByName(synthetic.select(*cols).withColumn("_source", F.lit("synthetic"))))
    return load_labeled(u, label_col, out)


def scan_clients(clients: DataFrame, active_only: bool = True) -> DataFrame:
    """Client projection, optionally only ``is_active = true``."""
    cols = ["id", "name", "industry_type", "client_location", "start_date", "status",
            "is_active", "health", "attrition_date", "created_at", "updated_at"]
    df = clients.select(*cols)
    return df.filter(F.col("is_active") == F.lit(True)) if active_only else df


def scan_team_members(members: DataFrame, active_only: bool = True) -> DataFrame:
    """Member projection, optionally only ``status = 'active'`` (exact)."""
    cols = ["id", "first_name", "last_name", "role", "status", "start_date", "client_id",
            "created_at", "updated_at"]
    df = members.select(*cols)
    return df.filter(F.col("status") == F.lit("active")) if active_only else df


def scan_attendance(att: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Rows with ``date >= as_of - days``."""
    cut = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS")
    return att.filter(F.col("date") >= cut)


def attrition_history(clients: DataFrame, members: DataFrame) -> DataFrame:
    """Inactive clients and members who left, one table, missing
    columns null, tagged with ``entity_type``."""
    c = (clients.filter(F.lower(F.col("status")) == "inactive")
         .withColumn("entity_type", F.lit("client")))
    m = (members.filter(~(F.lower(F.col("status")).eqNullSafe("active")))
         .withColumn("entity_type", F.lit("team_member")))
    return c.unionByName(m, allowMissingColumns=True)
