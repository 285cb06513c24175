"""Checks of input and features before a fit (SURVEY section 8: T3, T6, T7, T16,
T20, T21).  Each is one aggregation over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.values import NUMERIC_RE
from staywise.operators.metrics import hash_order, positions


def unmapped_share(df: DataFrame, col: str, known: Sequence[str]) -> DataFrame:
    """Values of a text column that are neither known words (whatever
    case and blanks) nor numbers: filled, unmapped, share of the filled."""
    v = F.lower(F.trim(F.col(col).cast("string")))
    filled = v.isNotNull() & (v != "")
    odd = filled & ~v.isin(*[k.lower() for k in known]) & ~v.rlike(NUMERIC_RE)
    out = df.agg(F.count_if(filled).alias("filled"), F.count_if(odd).alias("unmapped"))
    return out.withColumn("share", F.when(F.col("filled") > 0, F.col("unmapped") / F.col("filled")).otherwise(F.lit(0.0)))


def ambiguous_dates(df: DataFrame, col: str) -> DataFrame:
    """Text dates a/b/yyyy that read as two different days; the import
    takes the month first."""
    a, b = (F.regexp_extract(F.trim(F.col(col).cast("string")), r"^(\d{1,2})/(\d{1,2})/\d{4}(?: |$)", k).try_cast("int") for k in (1, 2))
    return df.agg(F.count_if(F.col(col).isNotNull()).alias("filled"),
                  F.count_if(a.between(1, 12) & b.between(1, 12) & (a != b)).alias("ambiguous"))


def constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value) of the columns that hold one value on all rows."""
    r = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"), (F.count, "n"))],
               F.count(F.lit(1)).alias("rows"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("value"),
                               ((F.col(f"lo_{c}") == F.col(f"hi_{c}")) & (F.col(f"n_{c}") == F.col("rows"))).alias("same")) for c in cols])
    return r.select(F.explode(pairs).alias("p")).select("p.*").where("same").drop("same")


def leaks(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Features whose value alone decides the label (each value always with
    one label, several rows a value on average): (feature, values)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("v")) for f in features])).alias("p"),
                     F.col(label).alias("y")).select("p.*", "y")
    per = long.groupBy("feature", "v").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count(F.lit(1)).alias("n"))
    by = per.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"), F.min("lo").alias("lo"),
                                    F.max("hi").alias("hi"), F.bool_and(F.col("lo").eqNullSafe(F.col("hi"))).alias("decided"))
    return by.where("decided and lo <> hi and rows >= 2 * values").select("feature", "values")


def three_way_split(df: DataFrame, y: str = "y", key: str = "id", seed: int = 42) -> DataFrame:
    """60 % train, 20 % validation (to choose a threshold on), 20 % test (to
    report on), exact per label in seeded hash order."""
    pos = positions(df.withColumn("_h", hash_order(F.col(key), seed)), [y], "_h", key)
    n = df.groupBy(F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))  # one row per label
    j = pos.join(n, F.col(y) == F.col("_y"))
    part = (F.when(F.col("pos") < F.round(F.col("_n") * 0.6), "train")
            .when(F.col("pos") < F.round(F.col("_n") * 0.8), "validation").otherwise("test"))
    return j.withColumn("split", part).drop("_h", "_n", "_y", "pos")
