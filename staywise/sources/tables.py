"""Reading the base parquet tables.

Each reader returns a lazy DataFrame; callers select the columns they use so
Catalyst prunes the scan (``ReadSchema``) and pushes filters into it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_if_exists(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A parquet table, or ``None`` if nothing was ever written there.  Any
    other failure (permission, network, a damaged file) is raised."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
