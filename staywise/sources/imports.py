"""Import of form files into the termination table, end to end."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from staywise.functions.values import parse_boolean
from staywise.operators import features as FT
from staywise.sources.ingest import (FORM_BOOLEAN_COLUMNS, FORM_HEADER_MAP, TERMINATION_COLUMNS, normalise_headers,
                                     read_csv_strings)
from staywise.sources.tables import read_if_exists

# What the feature step calls the table's columns.
FEATURE_INPUTS = {
    "notice_date": "termination_notice_date", "last_comm_date": "last_general_communication_date",
    "last_checkin_date": "last_official_checkin_date", "tm_start_date": "team_member_start_date",
    "tm_last_date": "team_member_last_date", "client_start_date": "client_start_date",
    "health_text": "client_health_last_month", "check_in_cadence": "check_in_cadence",
    "will_have_replacement": "will_have_replacement", "replacement_timeframe": "replacement_timeframe",
    "pip_implemented": "pip_implemented", "relief_offered": "relief_package_offered",
}

#: The codec of the table's files: digests as text are half their length under
#: one that codes characters, and as long as before under the default.
DIGESTS = "zstd"


class TerminationTable:
    """Termination rows that were imported from form files, with their features.

    An import appends what the table does not hold yet: a row is known by its
    content, and a content that a file holds n times is held n times, so
    importing a file again appends nothing while true repeats stay.  A row's id
    is its content's digest and its number among equals.

    Every import writes a folder of its own and then a manifest row (with the
    counts) that publishes it; the feature step notes the imports that it has
    done.  A run that breaks off leaves nothing that is seen, and the next one
    does the work.  One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = "sequence long, folder string, source string, total_rows long, dropped_rows long, appended_rows long"

    def imports(self) -> DataFrame:
        """One row an import: total, dropped (blank client name) and appended rows."""
        m = read_if_exists(self.spark, f"{self.root}/_imports", self.schema)
        return self.spark.createDataFrame([], self.schema) if m is None else m

    def _read(self, kind: str, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/{f}" for f in folders]).drop("w")

    def rows(self) -> DataFrame | None:
        """All published rows, in one scan; none before the first import."""
        return self._read("rows", [r["folder"] for r in self.imports().select("folder").collect()])  # a row an import

    def import_csv(self, path: str, mapping: Mapping[str, str] | None = None, multi_line: bool = False) -> dict[str, int]:
        """A1: one pass over the file: headers mapped, booleans parsed, rows with
        a blank client name dropped (B4), unknown rows appended, all counted by
        the write itself.  Returns total_rows, dropped_rows and appended_rows;
        ``compute_features`` is the step after it."""
        df = normalise_headers(read_csv_strings(self.spark, path, multi_line), mapping or FORM_HEADER_MAP)
        named = F.lit(True) if "client_name" not in df.columns else F.coalesce(F.trim("client_name") != "", F.lit(False))
        # columns that the file lacks are added to the new rows only: nulls are no part of a content's text
        cols = {c: parse_boolean(c).cast("int") if c in FORM_BOOLEAN_COLUMNS else F.col(c) for c in TERMINATION_COLUMNS if c in df.columns}
        cols = cols or {TERMINATION_COLUMNS[0]: F.lit(None).cast("string")}
        read, wrote = Observation(), Observation()
        df = df.select(*[c.alias(n) for n, c in cols.items()], named.alias("named_"))
        df = df.observe(read, F.count(F.lit(1)).alias("total"), F.count_if(~F.col("named_")).alias("dropped")).where("named_").drop("named_")
        held = F.struct(*cols)
        # the digest moves as its 32 bytes, its text is written again where it is stored
        per = df.groupBy(F.unhex(F.sha2(F.to_json(held, {"ignoreNullFields": "true"}), 256)).alias("content")).agg(F.count(F.lit(1)).alias("n"), F.first(held).alias("row"))
        stored = self.rows()
        if stored is None:
            per = per.withColumn("have", F.lit(0))
        else:
            have = stored.groupBy(F.unhex("content").alias("content")).agg(F.count(F.lit(1)).alias("have"))
            per = per.join(have, "content", "left").fillna(0, ["have"])
        new = per.where("n > have").withColumn("content", F.lower(F.hex("content"))).withColumn("copy", F.explode(F.sequence(F.col("have") + 1, F.col("n"))))
        every = [F.col(f"row.{c}") if c in cols else F.lit(None).cast("int" if c in FORM_BOOLEAN_COLUMNS else "string").alias(c) for c in TERMINATION_COLUMNS]
        new = new.select(F.concat_ws("-", "content", "copy").alias("id"), "content", *every).observe(wrote, F.count(F.lit(1)).alias("appended"))
        last = self.imports().agg(F.max("sequence")).first()[0]
        sequence = 0 if last is None else last + 1
        folder = f"w={sequence:010d}-{uuid.uuid4().hex[:12]}"
        new.write.option("compression", DIGESTS).parquet(f"{self.root}/rows/{folder}")
        counts = {"total_rows": read.get["total"], "dropped_rows": read.get["dropped"], "appended_rows": wrote.get["appended"]}
        self.spark.createDataFrame([(sequence, folder, path, *counts.values())], self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/_imports")
        return counts

    def _done(self) -> DataFrame:
        schema = "sequence long, folder string, feature_rows long"
        m = read_if_exists(self.spark, f"{self.root}/_featured", schema)
        return self.spark.createDataFrame([], schema) if m is None else m

    def compute_features(self) -> int:
        """The features of the imports that have none yet; only their rows
        are read.  Returns how many rows got features."""
        missing = self.imports().join(self._done().select("sequence"), "sequence", "left_anti").orderBy("sequence").collect()  # a row an import
        total = 0
        for r in missing:
            rows = self._read("rows", [r["folder"]])
            wrote = Observation()
            inputs = rows.select("id", *[F.col(c).alias(n) for n, c in FEATURE_INPUTS.items()])
            FT.form_features(inputs).observe(wrote, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", DIGESTS).parquet(f"{self.root}/features/{r['folder']}")
            n = wrote.get["n"]
            self.spark.createDataFrame([(r["sequence"], r["folder"], n)], "sequence long, folder string, feature_rows long").coalesce(1).write.mode(
                "append").parquet(f"{self.root}/_featured")
            total += n
        return total

    def rows_with_features(self, columns: Sequence[str]) -> DataFrame | None:
        """These ``columns`` of the rows that have features, with the features; the
        ids are matched as the digest's bytes and the number among equals."""
        rows, feats = self.rows(), self.features()
        if rows is None or feats is None:
            return None

        def by_id(df: DataFrame, id_col: str) -> DataFrame:
            return df.select(F.unhex(F.substring_index(id_col, "-", 1)).alias("digest_"), F.substring_index(id_col, "-", -1).cast("long").alias("copy_"),
                             *[c for c in df.columns if c != id_col])
        return by_id(feats, "termination_id").join(by_id(rows.select("id", *columns), "id"), ["digest_", "copy_"]).drop("digest_", "copy_")

    def features(self) -> DataFrame | None:
        """J1 features of all rows that have them."""
        return self._read("features", [r["folder"] for r in self._done().select("folder").distinct().collect()])
