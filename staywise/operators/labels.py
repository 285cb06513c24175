"""Labels (B1-B3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.sources.ingest import label_outcome  # noqa: F401  (B1 lives with the loaders)


def client_churn(df: DataFrame) -> Column:
    """B2: attrition date set OR lower(status) = 'inactive' OR is_active = false;
    null comparisons count as false."""
    cond = (F.col("attrition_date").isNotNull()
            | F.coalesce(F.lower(F.col("status")) == "inactive", F.lit(False))
            | F.coalesce(F.col("is_active") == F.lit(False), F.lit(False)))
    return cond.cast("int")


def member_attrition() -> Column:
    """lower(status) != 'active'; a null status counts as left."""
    return (~F.lower(F.col("status")).eqNullSafe("active")).cast("int")


def label_client_churn(df: DataFrame, out: str = "churned") -> DataFrame:
    return df.withColumn(out, client_churn(df))


def label_member_attrition(df: DataFrame, out: str = "left") -> DataFrame:
    return df.withColumn(out, member_attrition())
