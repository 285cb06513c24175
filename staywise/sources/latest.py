"""The last days of every entity, kept beside the daily store.

A daily job needs each entity's latest row and its last row before a given day.
The history that answers this grows with every day; this table does not: it
holds the last ``keep`` stored days of an entity, and a refresh merges only what
the store has published since the last one.  A day that lies before all kept
ones of an entity is answered from the history, for these entities alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staywise.operators import history as H
from staywise.session import materialize
from staywise.sources.store import DailyStore
from staywise.sources.tables import read_if_exists


class LatestTable:
    """Rows of ``store`` by bucket of their key: at most ``keep`` days an entity.

    A refresh writes the touched buckets to a folder of its own and then
    publishes them with the store's sequence number that they include, so an
    interrupted refresh changes nothing and a repeated one finds nothing to do.
    Merging is idempotent and does not depend on the order of days: it keeps,
    per entity, the rows of the greatest days.  ``older_`` on an entity's oldest
    kept row says that the store holds days before it.  One writer at a time;
    rows without a key are not kept (they belong to no entity)."""

    def __init__(self, store: DailyStore, root: str | None = None, keep: int = 4, buckets: int = 64):
        if keep < 2:
            raise ValueError("the latest day and one before it are the least")
        self.store, self.spark = store, store.spark
        self.root = (root or f"{store.root}/_latest").rstrip("/")
        self.key, self.day, self.keep, self.buckets = store.key, store.day, keep, buckets
        self.schema = "bucket int, sequence long, applied long, folder string"

    def manifest(self) -> DataFrame:
        m = read_if_exists(self.spark, f"{self.root}/_manifest", self.schema)
        return self.spark.createDataFrame([], self.schema) if m is None else m

    def rows(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The kept rows (and ``older_``) of all or some buckets, in one scan."""
        m = self.manifest().where(F.col("bucket").isNotNull())
        m = m if buckets is None else m.where(F.col("bucket").isin(buckets))
        # one row for each bucket
        found = m.groupBy("bucket").agg(F.max_by("folder", "sequence").alias("folder")).collect()
        if not found:
            return None
        paths = [f"{self.root}/{r['folder']}/bucket={r['bucket']}" for r in found]
        return self.spark.read.option("basePath", self.root).option("mergeSchema", True).parquet(*paths).drop("w", "bucket")

    def pending(self) -> tuple[list, int | None]:
        """(days that the store has published since the last refresh, its last sequence number)."""
        applied = self.manifest().agg(F.max("applied")).first()[0]
        m = self.store.manifest()
        new = m if applied is None else m.where(F.col("sequence") > applied)
        r = new.agg(F.collect_set(self.day).alias("days"), F.max("sequence").alias("last")).first()
        return sorted(r["days"]), r["last"]

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def refresh(self) -> int:
        """Merges what is pending; the number of rows read from the store."""
        days, last = self.pending()
        if last is None:
            return 0
        delta = self.store.current(days).where(F.col(self.key).isNotNull())
        delta = materialize(delta.withColumns({"older_": F.lit(False), "bucket": self._bucket()}))
        touched = {r["bucket"]: r["n"] for r in delta.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        m = self.manifest()
        number = (m.agg(F.max("sequence")).first()[0] if touched else None)
        sequence = 0 if number is None else number + 1
        folder = f"w={sequence:010d}-{uuid.uuid4().hex[:12]}"
        if touched:
            old = self.rows(sorted(touched))
            both = delta.drop("bucket") if old is None else delta.drop("bucket").unionByName(old, allowMissingColumns=True)
            kept = self._last(both).withColumn("bucket", self._bucket())
            kept.repartition(min(self.buckets, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        published = [(b, sequence, last, folder) for b in touched] or [(None, sequence, last, None)]
        self.spark.createDataFrame(published, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")
        return sum(touched.values())

    def _last(self, rows: DataFrame) -> DataFrame:
        """One row a day (the later row wins), the last ``keep`` days of each entity."""
        dropped = rows.groupBy(self.key).agg(F.max("older_").alias("dropped_"))
        one = H.one_per_day(rows.drop("older_"), self.key, self.store.ts, self.store.tb, self.day)
        w = Window.partitionBy(self.key)
        ranked = one.withColumns({"r_": F.row_number().over(w.orderBy(F.col(self.day).desc())), "n_": F.count(F.lit(1)).over(w)})
        ranked = ranked.join(dropped, self.key).where(F.col("r_") <= self.keep)
        oldest = F.col("r_") == F.least("n_", F.lit(self.keep))
        return ranked.withColumn("older_", oldest & (F.col("dropped_") | (F.col("n_") > self.keep))).drop("r_", "n_", "dropped_")

    def latest(self) -> DataFrame | None:
        """Every entity's row of its greatest day."""
        rows = self.rows()
        return None if rows is None else H.latest(rows.drop("older_"), self.key, (self.day,))

    def previous_level(self, new: DataFrame, batch_day: str, level_col: str = "risk_level") -> DataFrame:
        """``new`` with ``previous_day`` and ``previous_level``: each entity's
        last row before ``batch_day``, as ``history.previous_level`` gives it from
        the whole history.  Only if an entity's kept days all lie on or after
        ``batch_day`` and it has older ones is the history read, for such entities."""
        rows = self.rows()
        if rows is None:
            return new.withColumns({"previous_day": F.lit(None).cast("date"), "previous_level": F.lit(None).cast("string")})
        cut = F.to_date(F.lit(batch_day))
        per = rows.groupBy(self.key).agg(F.max("older_").alias("older"), F.min(self.day).alias("first"))
        unknown = per.where(F.col("older") & (F.col("first") >= cut)).select(self.key)
        known = rows.select(self.key, self.day, level_col)
        if not unknown.isEmpty():
            past = self.store.current().where(F.col(self.day) < cut)
            known = known.unionByName(past.join(unknown, self.key, "left_semi").select(self.key, self.day, level_col))
        return H.previous_level(new, known, self.key, batch_day, self.day, level_col)
