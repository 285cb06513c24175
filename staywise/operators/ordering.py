"""Positions and running sums in a total order, without a one-task window.

``sums_above`` needs nothing written: numbers are counted by cells first (their
leading digits), then by finer cells inside each, then by value, and the sums of
the three levels add up.

For values of any kind (``running_sums``, ``position``):
Rows are range-partitioned by the order, numbered inside each part, and shifted
by the totals of the parts before it; only those totals (one row per part) are
ever brought together.  The partitioning is written to the checkpoint folder
first, so that a recomputed task sees the same parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staywise.session import materialize


def _parts(df: DataFrame, order) -> DataFrame:
    return materialize(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))


def running_sums(df: DataFrame, group: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """For each (name, value) of ``sums`` adds ``name``: the sum of ``value``
    over the rows of the same ``group`` (columns without nulls; none: all rows)
    that come before the row in ``order`` (a total order within the group)."""
    parts = _parts(df, [*[F.col(g) for g in group], *order])
    inside = Window.partitionBy("part_", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumns({name: F.coalesce(F.sum(v).over(inside), F.lit(0)) for name, v in sums.items()})
    totals = parts.groupBy(*group, "part_").agg(*[F.sum(v).alias(f"sum_{name}") for name, v in sums.items()])
    shift = totals.select(*[F.col(g).alias(f"group_{g}") for g in group], F.col("part_").alias("p_"), *[
        F.coalesce(F.sum(f"sum_{name}").over(before), F.lit(0)).alias(f"shift_{name}") for name in sums])
    same = rows["part_"] == shift["p_"]
    for g in group:
        same &= rows[g] == shift[f"group_{g}"]
    out = rows.join(shift, same)
    out = out.withColumns({name: (F.col(name) + F.col(f"shift_{name}")).cast("long") for name in sums})
    return out.drop("part_", "p_", *[f"group_{g}" for g in group], *[f"shift_{name}" for name in sums])


def running_sum(df: DataFrame, group: str, order: list, value: str, name: str) -> DataFrame:
    return running_sums(df, [group], order, {name: value})


def position(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: the row's position (from 0) in ``order`` (a total order)."""
    parts = _parts(df, order)
    rows = parts.withColumn(name, F.row_number().over(Window.partitionBy("part_").orderBy(*order)))
    before = Window.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    shift = (parts.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
             .select(F.col("part_").alias("p_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("shift_")))
    out = rows.join(shift, rows["part_"] == shift["p_"])
    return out.withColumn(name, (F.col(name) + F.col("shift_") - 1).cast("long")).drop("part_", "p_", "shift_")


#: Cells of a unit: the first level, and both together.  Values past +-CLIP units share the last cells.
COARSE, FINE, CLIP = 1 << 12, 1 << 28, 1 << 8


def sums_above(df: DataFrame, group: list[str], value: str, sums: dict[str, str], totals: dict[str, str]) -> DataFrame:
    """For each (name, amount) of ``sums`` adds ``name``: the sum of ``amount``
    over the rows of the same ``group`` (columns without nulls; none: all rows)
    with a greater ``value``, a double that is unique in its group (null is the
    least); and for each
    (column, name) of ``totals`` the sum over all rows of the group.

    Lazy: three windows over (group), (group, coarse cell) and (group, fine
    cell), of at most 2 x CLIP x COARSE cells, FINE / COARSE cells and the
    values of a fine cell; nothing is written or run while the plan is made."""
    unit = F.least(F.greatest(F.col(value), F.lit(-float(CLIP))), F.lit(float(CLIP)))
    cells = {"coarse_": F.floor(unit * COARSE), "fine_": F.floor(unit * FINE)}
    rows = df.withColumns(cells)
    greater = (Window.unboundedPreceding, -1)

    def level(part: list[str], key: str, whole: dict[str, str]) -> DataFrame:
        per = rows.groupBy(*part, key).agg(*[F.sum(a).alias(f"sum_{n}") for n, a in sums.items()])
        w = Window.partitionBy(*part).orderBy(F.col(key).desc()).rowsBetween(*greater)
        return per.select(*[F.col(c).alias(f"{key}{c}") for c in (*part, key)], *[
            F.coalesce(F.sum(f"sum_{n}").over(w), F.lit(0)).alias(f"{key}{n}") for n in sums], *[
            F.sum(f"sum_{n}").over(Window.partitionBy(*part)).cast("long").alias(c) for c, n in whole.items()])

    inside = Window.partitionBy(*group, "fine_").orderBy(F.col(value).desc()).rowsBetween(*greater)
    out = rows.withColumns({n: F.coalesce(F.sum(a).over(inside), F.lit(0)) for n, a in sums.items()})
    for part, key, whole in (([*group, "coarse_"], "fine_", {}), (group, "coarse_", totals)):
        above = level(part, key, whole)
        on = [F.col(c).eqNullSafe(F.col(f"{key}{c}")) for c in (*part, key)]
        same = on[0]
        for o in on[1:]:
            same &= o
        out = out.join(above, same).withColumns({n: (F.col(n) + F.col(f"{key}{n}")).cast("long") for n in sums})
        out = out.drop(*[c for c in above.columns if c not in totals])
    return out.drop("coarse_", "fine_")
