"""Which ids a table has, without reading its ids: Bloom filters by part.

A part (a month) has a filter of blocks of 512 bits.  An id belongs to one
block and sets eight bits in it, so a filter is a small table of rows (part,
blocks, block, eight words), built, merged (bitwise or) and asked with plain
aggregations and joins.  Sixteen bits an id keep false hits at about one in a
thousand.  Where a part outgrows its filter, a larger one is begun beside it
and the full one is kept: their number grows with the logarithm of the ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.session import checkpoint_dir, materialize
from staywise.sources.tables import read_if_exists

WORDS, PROBES = 8, 8
#: Ids of a block: 512 bits at sixteen an id.
LOAD = 32
#: A part's next filter is so many times as large.
GROWTH = 4


def _mask(id_col: str):
    """The eight words of the bits that an id sets in its block."""
    h = F.xxhash64(F.col(id_col), F.lit(1))
    spots = [F.shiftrightunsigned(h, 7 * k).bitwiseAND(F.lit(511)) for k in range(PROBES)]
    out = []
    for w in range(WORDS):
        bits = [F.when(F.shiftright(s, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
                for s in spots]
        word = bits[0]
        for b in bits[1:]:
            word = word.bitwiseOR(b)
        out.append(word)
    return out


def _block(id_col: str, blocks):
    return F.pmod(F.xxhash64(F.col(id_col)), blocks)


class MonthFilters:
    """Filters of the ids of each part, below ``root``.

    ``add`` writes the touched parts' merged filters to a folder of their own and
    then publishes them in a manifest, so an ``add`` that breaks off changes
    nothing and a repeated one sets the same bits.  Add ids *before* the rows
    are written: then every stored id has its bits, and ``maybe`` misses none.
    Null ids are asked for and found like any value.  One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, part: str = "notice_month", key: str = "termination_id",
                 least_blocks: int = 64):
        self.spark, self.root, self.part, self.key, self.least = spark, root.rstrip("/"), part, key, least_blocks
        self.schema = "part string, sequence long, folder string, blocks array<long>, n array<long>"
        self.words = [f"w{k}" for k in range(WORDS)]

    def _state(self, parts: list[str] | None = None) -> dict:
        """Each part's published folder with the blocks and ids of its filters."""
        m = read_if_exists(self.spark, f"{self.root}/_manifest", self.schema)
        if m is None:
            return {}
        m = m if parts is None else m.where(F.col("part").isin(parts))
        last = m.groupBy("part").agg(F.max_by(F.struct("sequence", "folder", "blocks", "n"), "sequence").alias("r")).collect()
        return {r["part"]: r["r"] for r in last}

    def parts(self) -> set:
        """The parts that have a filter."""
        return set(self._state())

    def _rows(self, state: dict) -> DataFrame:
        paths = [f"{self.root}/{r['folder']}/part={p}" for p, r in state.items()]
        schema = "blocks long, block long, " + ", ".join(f"{w} long" for w in self.words) + ", part string"
        return self.spark.read.option("basePath", self.root).schema(schema).parquet(*paths)

    def maybe(self, ids: DataFrame, parts: list[str]) -> DataFrame | None:
        """The (part, key) rows of ``ids`` that may be stored; None where no part has a filter."""
        state = self._state(parts)
        if not state:
            return None
        sizes = self.spark.createDataFrame([(p, b) for p, r in state.items() for b in r["blocks"]], "p_ string, b_ long")
        masks = [m.alias(f"m{k}") for k, m in enumerate(_mask(self.key))]
        asked = ids.select(self.part, self.key, *masks).join(F.broadcast(sizes), F.col(self.part) == F.col("p_"))
        asked = asked.withColumn("k_", _block(self.key, F.col("b_")))
        f = self._rows(state)
        same = (F.col("p_") == F.col("part")) & (F.col("b_") == F.col("blocks")) & (F.col("k_") == F.col("block"))
        hit = F.lit(True)
        for k, w in enumerate(self.words):
            hit = hit & (F.col(w).bitwiseAND(F.col(f"m{k}")) == F.col(f"m{k}"))
        return asked.join(f, same).where(hit).select(self.part, self.key).distinct()

    def add(self, ids: DataFrame, counts: dict | None = None) -> None:
        """Sets the bits of (part, key) rows; parts are as few as the months of a
        batch.  ``counts``: the rows of each part, if the caller has counted them."""
        if counts is None:
            counts = {r[0]: r["n"] for r in ids.groupBy(self.part).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            return
        state, published, goal = self._state(sorted(counts)), [], []
        everything = read_if_exists(self.spark, f"{self.root}/_manifest", self.schema)
        last = None if everything is None else everything.agg(F.max("sequence")).first()[0]
        sequence = 0 if last is None else last + 1
        folder = f"w={sequence:010d}-{uuid.uuid4().hex[:12]}"
        for p, new in counts.items():
            blocks, n = (list(state[p]["blocks"]), list(state[p]["n"])) if p in state else ([], [])
            if not blocks or n[-1] + new > LOAD * blocks[-1]:
                size = max(self.least, blocks[-1] * GROWTH if blocks else 0)
                while LOAD * size < new:
                    size *= GROWTH
                blocks, n = [*blocks, size], [*n, 0]
            n[-1] += new
            goal.append((p, blocks[-1]))
            published.append((p, sequence, folder, blocks, n))
        sizes = self.spark.createDataFrame(goal, "part string, blocks long")
        rows = ids.select(F.col(self.part).alias("part"), self.key, *[m.alias(w) for w, m in zip(self.words, _mask(self.key))])
        rows = rows.join(F.broadcast(sizes), "part").withColumn("block", _block(self.key, F.col("blocks")))
        cols = ["part", "blocks", "block", *self.words]
        rows = rows.select(*cols)
        if state:
            rows = rows.unionByName(self._rows(state).select(*cols))
        merged = rows.groupBy("part", "blocks", "block").agg(*[F.bit_or(w).alias(w) for w in self.words])
        merged.write.partitionBy("part").parquet(f"{self.root}/{folder}")
        self.spark.createDataFrame(published, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")


def _written_once(df: DataFrame) -> DataFrame:
    """``df`` from files in the shared checkpoint folder, computed once: a checkpoint
    computes its rows twice, once to count and once to write, and keeps them
    whole, where a pass over the ids should read no more than these."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/staywise-batch-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class FeatureTable:
    """Rows by month, one per id, appended with ``append``: ids that are stored
    already write nothing.

    New ids are told by the month's filter; stored ids are read only if the
    batch has hits, only in the hits' months, and semi-joined to the hits (by
    literal ids, which reach Parquet's own filters, where the hits are a few)."""

    FEW = 10

    def __init__(self, spark: SparkSession, path: str, part: str = "notice_month", key: str = "termination_id",
                 filters: str | None = None, least_blocks: int = 64):
        self.spark, self.path, self.part, self.key = spark, path.rstrip("/"), part, key
        self.filters = MonthFilters(spark, filters or f"{self.path}-filters", part, key, least_blocks)

    def rows(self) -> DataFrame | None:
        stored = read_if_exists(self.spark, self.path)
        # a table of one unnamed month would be read with another type
        return None if stored is None else stored.withColumn(self.part, F.col(self.part).cast("string"))

    def ids(self, parts: list[str]) -> DataFrame | None:
        """(part, key) of the stored rows of these parts: a filter on the partition column."""
        rows = self.rows()
        return None if rows is None else rows.where(F.col(self.part).isin(parts)).select(self.part, self.key)

    def append(self, rows: DataFrame) -> dict:
        """Writes the rows whose ids are new; how many rows came, hit a filter,
        were stored, and were written.  Of rows that share an id one is kept."""
        rows = _written_once(rows.dropDuplicates([self.part, self.key]))
        per = {r[0]: r["n"] for r in rows.groupBy(self.part).agg(F.count(F.lit(1)).alias("n")).collect()}  # the months of a batch
        parts = list(per)
        ids = rows.select(self.part, self.key)
        out = {"rows": sum(per.values()), "hits": 0, "stored": 0}
        unknown = sorted(set(parts) - self.filters.parts())
        before = self.ids(unknown) if unknown else None
        if before is not None:  # a table that was begun without filters
            self.filters.add(before)
        hits = self.filters.maybe(ids, parts)
        if hits is not None:
            hits = materialize(hits)
            n = {r[0]: r["n"] for r in hits.groupBy(self.part).agg(F.count(F.lit(1)).alias("n")).collect()}
            out["hits"] = sum(n.values())
            stored = self.ids(sorted(n)) if n else None
            if stored is not None:
                few = [r[0] for r in hits.select(self.key).collect()] if out["hits"] <= self.FEW else [None]
                if None not in few:
                    stored = stored.where(F.col(self.key).isin(few))
                same = [F.col(f"h.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (self.part, self.key)]
                known = materialize(hits.alias("h").join(stored.alias("s"), same, "left_semi"))
                out["stored"] = known.count()
                same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (self.part, self.key)]
                rows = rows.alias("r").join(known.alias("k"), same, "left_anti")
        out["written"] = out["rows"] - out["stored"]
        if out["written"]:
            self.filters.add(rows.select(self.part, self.key), None if out["stored"] else per)  # before the rows: no stored id lacks its bits
            rows.write.mode("append").option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy(self.part).parquet(self.path)
        return out
