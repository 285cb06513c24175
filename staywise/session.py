"""Session construction and cluster-level settings.

On a cluster the session already exists and carries the operator's settings;
``get_session`` only fills in what is unset, so the cluster's
``spark.checkpoint.dir`` (a shared folder) always wins over local defaults.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins at runtime (converting a
# sort-merge join to a broadcast one only when the measured side is small,
# splitting skewed shuffle partitions, coalescing tiny ones).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "staywise",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one for tests/benchmarks."""
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("STAYWISE_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Pin the settings correctness depends on (UTC session time zone)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir``.  Where it is unset, a scratch folder
    is created and registered under a ``local`` master only: on a cluster each
    executor would write to a disk of its own, so there it is an error.
    Lineage is always cut with reliable ``checkpoint()`` or a written table
    there, never with ``localCheckpoint``.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="staywise-ckpt-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df):
    """Cut the lineage of a DataFrame that feeds many passes (model fits,
    cross-validation): a reliable checkpoint written to the shared
    ``spark.checkpoint.dir``, so a lost executor re-reads the written blocks
    instead of recomputing the whole input plan (never ``localCheckpoint``)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Fewer rows stay in the partitions that they are in.
EVEN_ROWS = 1 << 18


def evenly(df, rows: int):
    """The ``rows`` rows of ``df`` dealt evenly, two tasks a core.  A fit passes over
    its rows hundreds of times and each pass lasts as long as its busiest core;
    partitions coalesced to about one a core leave most of them waiting."""
    if rows < EVEN_ROWS:
        return df
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``staywise`` importable in the Python workers (needed by the
    ``mapInPandas`` / ``applyInPandasWithState`` steps, whose functions are
    pickled by reference).  The package is zipped once on the driver and
    distributed with ``addPyFile``, as ``--py-files`` would; a no-op when it
    was already shipped to this context."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="staywise-pyfiles-"), "staywise.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
