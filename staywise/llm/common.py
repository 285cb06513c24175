"""Small helpers shared by the operators: input columns, Arrow maps, lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.session import checkpoint_dir, ship_package

#: Rows per Arrow batch sent to Python.  A batch holds whole texts, so the
#: number of rows (not the JVM default of 10,000) bounds a worker's memory.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers, name the shared checkpoint folder and
    keep Arrow batches small enough for tables of long texts."""
    ship_package(spark)
    checkpoint_dir(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under fixed names; every other column (whatever
    its name) is left out, so none can clash with the operator's own."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in cols.items()])


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: a lost executor's part is read again."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One Arrow batch in, one out (``None``: nothing)."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """Binary column as a list, nulls as empty."""
    return [x or b"" for x in column.to_pylist()]


def slices(texts: list[bytes], rows: int, size: int = 4 << 20) -> Iterator[slice]:
    """Runs of at most ``rows`` texts and ``size`` bytes (a longer text by itself)."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        if k > lo and (k - lo >= rows or held + len(t) > size):
            yield slice(lo, k)
            lo, held = k, 0
        held += len(t)
    if lo < len(texts):
        yield slice(lo, len(texts))


def i64(values) -> pa.Array:
    """numpy integers (uint64 included, same bits) as an Arrow long array."""
    a = np.ascontiguousarray(values)
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64, copy=False))


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
