"""Pairs inside buckets, without a self-join.

Rows carry a bucket key.  Small buckets are packed, many at a time, into work
groups; a bucket with more than ``tile_rows`` rows is cut into tiles and each
pair of its tiles becomes a work group of its own, so no task ever holds a hot
bucket.  Pairs are only formed inside a task, in numpy, and only what a caller
keeps of them leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import count_rows


def work_groups(rows: DataFrame, tile_rows: int, group_rows: int, level: str | None = None, reach: int = 0) -> DataFrame:
    """``rows`` has ``bucket`` (long), ``spread`` (long, splits a hot bucket
    evenly) and payload columns.  Returns the rows with ``work`` (the group to
    gather by) and ``side`` (0: all pairs inside a bucket, 1 and 2: only pairs
    of a left with a right row).

    ``level`` names an integer column; tiles then hold one level each, and
    pairs of tiles whose levels differ by more than ``reach`` are left out."""
    lev = F.col(level) if level else F.lit(0)
    rows = rows.withColumn("lev_", lev.cast("int"))
    sizes = rows.groupBy("bucket", "lev_").agg(F.count(F.lit(1)).alias("n_"))
    totals = sizes.groupBy("bucket").agg(F.sum("n_").alias("n_"))
    alone = totals.where(f"n_ > {tile_rows}").select("bucket", F.lit(True).alias("hot_"))
    total, most = totals.agg(F.coalesce(F.sum("n_"), F.lit(0)), F.coalesce(F.max("n_"), F.lit(0))).first()
    n_groups = max(1, -(-int(total) // group_rows))
    packed = F.pmod(F.xxhash64("bucket", F.lit(11)), F.lit(n_groups))
    if most <= tile_rows:
        return rows.withColumn("work", packed).withColumn("side", F.lit(0)).drop("lev_")
    rows = rows.join(alone, "bucket", "left")
    small = rows.where("hot_ is null").withColumn("work", packed).withColumn("side", F.lit(0))
    tiles = (sizes.join(alone, "bucket").withColumn("k_", F.ceil(F.col("n_") / tile_rows).cast("int"))
             .withColumn("sub_", F.explode(F.sequence(F.lit(0), F.col("k_") - 1)))
             .select("bucket", "lev_", "k_", "sub_"))
    t2 = tiles.select("bucket", F.col("lev_").alias("lev2_"), F.col("k_").alias("k2_"), F.col("sub_").alias("sub2_"))
    pairs = tiles.join(t2, "bucket").where(
        (F.struct("lev_", "sub_") <= F.struct("lev2_", "sub2_")) & (F.col("lev2_") - F.col("lev_") <= reach))
    same = (F.col("lev_") == F.col("lev2_")) & (F.col("sub_") == F.col("sub2_"))
    pairs = pairs.withColumn("work", F.xxhash64("bucket", "lev_", "sub_", "lev2_", "sub2_"))
    left = pairs.select("bucket", "lev_", "sub_", "k_", "work", F.when(same, 0).otherwise(1).alias("side"))
    right = pairs.where(~same).select("bucket", F.col("lev2_").alias("lev_"), F.col("sub2_").alias("sub_"),
                                      F.col("k2_").alias("k_"), "work", F.lit(2).alias("side"))
    route = left.unionByName(right)
    counts = tiles.groupBy("bucket", "lev_").agg(F.max("k_").alias("k_"))
    hot = rows.where("hot_").join(counts, ["bucket", "lev_"])
    hot = hot.withColumn("sub_", F.pmod(F.xxhash64("spread", F.lit(13)), F.col("k_")).cast("int")).drop("k_")
    hot = hot.join(route.drop("k_"), ["bucket", "lev_", "sub_"]).drop("sub_")
    return small.unionByName(hot.select(*small.columns)).drop("hot_", "lev_")


def pair_chunks(bucket: np.ndarray, side: np.ndarray, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one gathered work group, a bounded number at a time.
    The arrays must be sorted by (side, bucket)."""
    left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    if len(left) and len(right):
        step = max(1, chunk // len(right))
        for at in range(0, len(left), step):
            part = left[at:at + step]
            yield np.repeat(part, len(right)), np.tile(right, len(part))
    inner = np.flatnonzero(side == 0)
    b = bucket[inner]
    at, d = np.arange(max(0, len(inner) - 1)), 1
    while len(at):
        at = at[b[at] == b[at + d]]
        for k in range(0, len(at), chunk):
            i = at[k:k + chunk]
            yield inner[i], inner[i + d]
        d += 1
        at = at[at + d < len(inner)]


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (u, v): each node with the least node of
    its component, the least itself left out."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[:len(u)], flat[len(u):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]
