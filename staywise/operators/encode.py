"""Categorical encoders.

A vocabulary is a small DataFrame (value, code).  Joining it back is left to
Catalyst/AQE: the vocabulary side is broadcast when its measured size is under
the broadcast threshold, and a sort-merge join (with AQE skew splitting) is
used otherwise - so a hot category never funnels into one task through a
shuffle, and an unexpectedly large vocabulary is never broadcast blindly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.operators.ordering import position, running_sums


def _value(col: str, fill: str | None):
    c = F.col(col).cast("string")
    return F.coalesce(c, F.lit(fill)) if fill is not None else c


def fit_vocabulary(df: DataFrame, col: str, fill: str | None = None) -> DataFrame:
    """E6 fit: sorted distinct values -> code 0..k-1 (alphabetical, as a label
    encoder).  The distinct values are numbered over even ranges."""
    distinct = df.select(_value(col, fill).alias("value")).distinct()
    return position(distinct, [F.col("value")], "code")


def label_encode(df: DataFrame, col: str, vocab: DataFrame, out: str, fill: str | None = None,
                 unseen: str | None = None, reserved_code: int | None = None) -> DataFrame:
    """E6/H19 transform: code of ``coalesce(col, fill)``; a value missing from
    the vocabulary is replaced by ``unseen`` first and, when even that is not
    in the vocabulary, gets ``reserved_code`` (trap T5) instead of failing."""
    key = f"__{out}_key"
    v = vocab.select(F.col("value").alias(key), F.col("code").alias(out))
    joined = df.withColumn(key, _value(col, fill)).join(v, key, "left")
    if unseen is not None:
        # the unseen-value code is one scalar of the stored vocabulary
        row = vocab.filter(F.col("value") == F.lit(unseen)).select("code").first()
        if row is not None:
            joined = joined.withColumn(out, F.coalesce(F.col(out), F.lit(row["code"])))
    if reserved_code is not None:
        joined = joined.withColumn(out, F.coalesce(F.col(out), F.lit(reserved_code)))
    return joined.drop(key)


def fit_transform(df: DataFrame, col: str, out: str, fill: str | None = None) -> DataFrame:
    return label_encode(df, col, fit_vocabulary(df, col, fill), out, fill)


def factorize(df: DataFrame, col: str, out: str, order_by: str = "id", fill: str | None = None) -> DataFrame:
    """Code by first appearance in ``order_by`` order.  First appearance
    per value is a partial aggregation; only the distinct values are numbered,
    over even ranges."""
    key = f"__{out}_key"
    d = df.withColumn(key, _value(col, fill))
    first = d.groupBy(key).agg(F.min(order_by).alias("__first"))
    codes = position(first, [F.col("__first"), F.col(key)], out).select(key, out)
    return d.join(codes, key, "left").drop(key)


def fit_vocabularies(df: DataFrame, cols: dict[str, str | None]) -> DataFrame:
    """E6 fit for several columns in one pass: (column, value) pairs are
    exploded and de-duplicated with one shuffle, then coded per column.  The
    per-column encoders all read this one table, so the input is scanned
    once for all vocabularies (the exchange below the distinct is reused)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _value(c, fill).alias("value"))
                                for c, fill in cols.items()]))
    d = df.select(pairs.alias("p")).select("p.*").distinct()
    return running_sums(d.withColumn("one_", F.lit(1)), ["column"], [F.col("value")], {"code": "one_"}).drop("one_")


def vocabulary(vocabs: DataFrame, col: str) -> DataFrame:
    return vocabs.filter(F.col("column") == F.lit(col)).select("value", "code")
