"""Dictionaries whose codes never move (E6, E7, H19, trap T5).

A label encoder fitted anew on every run gives a value another code as soon as a
smaller value appears, so a stored model reads the wrong category.  Here codes
are assigned once: a run appends the values that are not there yet, numbered
from the column's next free code in order of value.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.operators.ordering import running_sums
from staywise.session import materialize
from staywise.sources.tables import read_if_exists


class Dictionary:
    """(column, value, code) below ``root``, append-only.  A run writes a folder
    of its own and then the manifest row that publishes it; one that breaks off
    leaves nothing that is seen.  One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = "sequence long, folder string, added long"

    def manifest(self) -> DataFrame:
        m = read_if_exists(self.spark, f"{self.root}/_manifest", self.schema)
        return self.spark.createDataFrame([], self.schema) if m is None else m

    def table(self) -> DataFrame:
        """All published codes, in one scan."""
        folders = [r["folder"] for r in self.manifest().where("added > 0").collect()]  # a row a run
        if not folders:
            return self.spark.createDataFrame([], "column string, value string, code long")
        return self.spark.read.option("basePath", self.root).parquet(*[f"{self.root}/{f}" for f in folders]).select("column", "value", "code")

    def vocabulary(self, column: str) -> DataFrame:
        """(value, code) of one column, as ``encode.label_encode`` takes it."""
        return self.table().where(F.col("column") == column).select("value", "code")

    def extend(self, df: DataFrame, columns: Mapping[str, str | None]) -> int:
        """Adds the values of ``columns`` (column -> what stands for null; None:
        nulls have no code) that have no code; how many these are."""
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias("value"))
                                    for c, fill in columns.items()]))
        seen = df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
        known = self.table()
        new = materialize(seen.join(known.select("column", "value"), ["column", "value"], "left_anti"))
        added = new.agg(F.count(F.lit(1))).first()[0]
        if added:
            # the next free code of each column: one row a column
            free = known.groupBy("column").agg((F.max("code") + 1).alias("free"))
            ranked = running_sums(new.withColumn("one_", F.lit(1)), ["column"], [F.col("value")], {"place": "one_"})
            rows = ranked.join(free, "column", "left").select("column", "value", (F.coalesce("free", F.lit(0)) + F.col("place")).cast("long").alias("code"))
            last = self.manifest().agg(F.max("sequence")).first()[0]
            sequence = 0 if last is None else last + 1
            folder = f"w={sequence:010d}-{uuid.uuid4().hex[:12]}"
            rows.write.parquet(f"{self.root}/{folder}")
            self.spark.createDataFrame([(sequence, folder, added)], self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")
        return added
