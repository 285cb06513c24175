"""Substring search by three-letter postings.

A scan reads every name for every term typed.  The index holds, for each three
letters of a lower-cased field, the keys of the rows that have them; a term of
three letters and more needs only the postings of its rarest letters, and the
rows they name are verified by the plain search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from staywise.operators import summary as S
from staywise.sources.tables import read_if_exists

SIZE = 3


def grams_of(term: str) -> list[str]:
    """The distinct three-letter pieces of a lower-cased term, in order."""
    t = term.lower()
    return list(dict.fromkeys(t[k:k + SIZE] for k in range(len(t) - SIZE + 1)))


def gram_column(field: str):
    """The distinct three-letter pieces of a lower-cased column (empty where it is null or shorter)."""
    t = F.lower(F.col(field))
    pieces = F.transform(F.sequence(F.lit(1), F.length(t) - (SIZE - 1)), lambda k: F.substring(t, k, F.lit(SIZE)))
    return F.when(F.length(t) >= SIZE, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


class SearchIndex:
    """Postings (field, gram, key) of ``fields`` below ``root``.

    ``refresh`` adds the rows whose texts are not indexed yet: postings first,
    then how often each gram stands in them, then the texts' digests, so a
    refresh that breaks off is done again.  Postings that are there twice, or
    of a text that a key no longer has, cost a verification and change no
    result.  Postings lie in ranges of (gram, key): a term's are a few row groups, and a
    gram that a third of the rows hold is spread over files by key.

    ``search`` equals ``summary.search`` on rows whose texts were refreshed.  Rows
    without a key are always scanned; so is everything where the term has fewer
    than three letters or its rarest gram stands in over ``share`` of the texts."""

    def __init__(self, spark: SparkSession, root: str, key: str = "client_id",
                 fields=("client_name", "industry_type"), share: float = 0.1, grams: int = 3):
        self.spark, self.root, self.key, self.fields = spark, root.rstrip("/"), key, tuple(fields)
        self.share, self.grams = share, grams

    def _read(self, name: str) -> DataFrame | None:
        return read_if_exists(self.spark, f"{self.root}/{name}")

    def _digest(self):
        return F.sha2(F.to_json(F.struct(*[F.lower(F.col(f)).alias(f) for f in self.fields])).cast("binary"), 256)

    def refresh(self, rows: DataFrame) -> int:
        """Indexes the texts that are not indexed yet; how many they were."""
        d = rows.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), *self.fields, self._digest().alias("digest"))
        d = d.dropDuplicates(["key", "digest"])
        known = self._read("texts")
        if known is not None:
            d = d.join(known.select("key", "digest"), ["key", "digest"], "left_anti")
        parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), gram_column(f).alias("grams")) for f in self.fields]))
        posts = d.select("key", parts.alias("p")).select(F.col("p.field").alias("field"), F.explode("p.grams").alias("gram"), "key")
        posts.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("append").parquet(f"{self.root}/postings")
        counts = posts.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("append").parquet(f"{self.root}/counts")
        seen = Observation()
        d.select("key", "digest").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{self.root}/texts")
        return seen.get["n"]

    def plan(self, term: str) -> dict[str, list[str]] | None:
        """Per field that can hold the term, its rarest grams; None where a scan is the better way."""
        wanted, counts = grams_of(term), self._read("counts")
        if not wanted or counts is None:
            return None
        n = self._read("texts").count()  # from the files' footers
        found = counts.where(F.col("gram").isin(wanted)).groupBy("field", "gram").agg(F.sum("n").alias("n")).collect()
        out = {}
        for f in self.fields:
            have = sorted((r["n"], r["gram"]) for r in found if r["field"] == f)
            if len(have) == len(wanted):
                if have[0][0] > self.share * n:
                    return None
                out[f] = [g for _, g in have[:self.grams]]
        return out

    def candidates(self, plan: dict[str, list[str]]) -> DataFrame:
        """(k_): the keys that hold all the planned grams in one field, and null."""
        posts = self._read("postings")
        null = self.spark.range(1).select(F.lit(None).cast(posts.schema["key"].dataType).alias("key"))
        found = null
        for f, grams in plan.items():
            bit = F.coalesce(*[F.when(F.col("gram") == g, F.lit(1 << k)) for k, g in enumerate(grams)])
            p = posts.where((F.col("field") == f) & F.col("gram").isin(grams)).groupBy("key").agg(F.bit_or(bit).alias("m"))
            found = found.unionByName(p.where(F.col("m") == (1 << len(grams)) - 1).select("key"))
        return found.withColumnRenamed("key", "k_")

    def search(self, df: DataFrame, term: str, level: str = "all") -> DataFrame:
        plan = self.plan(term)
        if plan == {}:  # no indexed text holds the term
            df = df.where(F.col(self.key).isNull())
        elif plan is not None:
            hits = self.candidates(plan)
            df = df.join(hits, F.col(self.key).eqNullSafe(F.col("k_")), "left_semi")
        return S.search(df, term, level, self.fields)
