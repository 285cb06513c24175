"""Exact top-k search by inner product: distributed histogram selection.

All pairs of a query block and a candidate block are scored (the stated query
set against all rows, in blocks of bounded size).  Each round narrows, for all
queries at once, the interval that holds the k-th best score: blocks report a
histogram of their scores in the interval, the sums over all blocks tell which
bin holds the k-th, and that bin is the next interval, until it is one score
wide.  A last pass keeps scores from the k-th up and breaks ties by id.

A block reports its bins from the top and stops once they hold as many scores
as are still wanted: the bins below cannot hold the k-th.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staywise.llm.common import cut, i64, pick, prepare
from staywise.operators.ordering import position

QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Bits by which a round narrows the interval.
BITS = 10


def usable(column: str):
    """Not null, no null and no non-finite component."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & finite, F.lit(False))


def integer_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of each component, usable rows with an id only."""
    d = pick(vectors, id=id_col, v=vector_col).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    d = d.where(F.col("id").isNotNull() & usable("v"))
    return d.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _numbered(c: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Where rows share an id, the distinct ones go by their position in the
    order of id and vector instead, which ranks ties as ids do; a query that is
    not among the candidates goes by a negative number.  Then the table (key_,
    name_) of both, else None."""
    if all(n == ids for n, ids in (d.agg(F.count("id"), F.count_distinct("id")).first() for d in (c, q))):
        return c, q, None
    c, q, order = c.distinct(), q.distinct(), [F.col("id"), F.col("v")]
    c = cut(position(c, order, "key_"))
    known = c.select(F.col("id").alias("i_"), F.col("v").alias("x_"), "key_")
    q = position(q, order, "at_").join(known, (F.col("id") == F.col("i_")) & (F.col("v") == F.col("x_")), "left")
    q = cut(q.select("id", "v", F.coalesce("key_", -1 - F.col("at_")).alias("key_")))
    names = c.select("key_", F.col("id").alias("name_")).unionByName(q.where("key_ < 0").select("key_", F.col("id").alias("name_")))
    return (*(d.select(F.col("key_").alias("id"), "v") for d in (c, q)), names)


def matrix(t: pa.Table) -> np.ndarray:
    col = t["v"].combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while sums stay below 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -2**62, 2**62 - 1).astype(np.int64)


def _scored(q: pa.Table, c: pa.Table, rows: int = 256):
    """(query slice, scores) of one block pair, a query's own row set aside, by vector length."""
    if not q.num_rows or not c.num_rows:
        return
    ids = c["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    cm, ids = matrix(c)[order], ids[order]
    qm, own = matrix(q), q["id"].to_numpy()
    for at in range(0, len(own), rows):
        part = slice(at, at + rows)
        s = products(qm[part], cm)
        pos = np.searchsorted(ids, own[part])
        hit = (pos < len(ids)) & (ids[np.minimum(pos, len(ids) - 1)] == own[part])
        mask = np.ones(s.shape, bool)
        mask[np.flatnonzero(hit), pos[hit]] = False
        yield part, s, mask, ids


def _histogram(wide: int, shift: int):
    """Counts of a block's scores by bin of 2**shift, in [low, low + 2**wide)."""

    def of(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        ids, low, want = (a[x].to_numpy() for x in ("id", "low", "want"))
        for part, s, mask, _ in _scored(a, b):
            at = s - low[part, None]
            bins = np.where(mask & (at >= 0) & ((at >> np.int64(wide)) == 0), at >> np.int64(shift), -1)
            for row, qid, need in zip(bins, ids[part], want[part]):
                row = row[row >= 0]
                if len(row) > need:  # down to the bin of the block's own last wanted score, whole
                    row = row[row >= np.partition(row, len(row) - need)[len(row) - need]]
                v, n = np.unique(row, return_counts=True)
                out.append((np.full(len(v), qid), v, n))
        cols = zip(*out) if out else ([np.zeros(0, np.int64)],) * 3
        return pa.table([i64(np.concatenate(x)) for x in cols], ["id", "bin", "n"])

    return of


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, **cols: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of
    every query with all other rows, ties to the smaller id; all rows where
    there are fewer than k.

    Vectors that are null, hold a null or a non-finite component, or have no id
    take no part; only vectors of one length are scored with each other.  Rows
    equal in id and vector are one row; different vectors under one id are rows
    of their own, each with its ranks as a query.  Where no id repeats, a
    query's own row is the one with its id.  Scores past 62 bits are
    clipped there.  Empty tables give an empty result."""
    spark = vectors.sparkSession
    prepare(spark)
    c, q, names = _numbered(integer_vectors(vectors, scale, **cols), integer_vectors(queries, scale, **cols))
    c, q = cut(c.withColumn("dim", F.size("v"))), cut(q.withColumn("dim", F.size("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    n, longest = c.agg(F.count(F.lit(1)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    m, widest = q.agg(F.count(F.lit(1)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    top = min(62, int(np.ceil(np.log2(longest * widest * (1 + 1e-9) + 2))))
    q_blocks, c_blocks = max(1, -(-m // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))

    def grid(d: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        d = d.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    cells = ["dim", "q_block", "c_block"]
    right = grid(c, "c_block", c_blocks, "q_block", q_blocks).select(*cells, "id", "v").groupBy(*cells)

    def over(state: DataFrame, fn, schema: str) -> DataFrame:
        left = q.join(state.withColumnRenamed("id", "s_"), F.col("id") == F.col("s_")).drop("s_")
        left = grid(left, "q_block", q_blocks, "c_block", c_blocks).select(*cells, "id", "v", "low", "want")
        return left.groupBy(*cells).cogroup(right).applyInArrow(fn, schema)

    state = q.select("id", F.lit(-(1 << top)).cast("long").alias("low"), F.lit(k).cast("long").alias("want"))
    shift = top + 1
    while shift > 0:
        wide, shift = shift, max(0, shift - BITS)

        h = over(state, _histogram(wide, shift), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("s_").orderBy(F.desc("bin"))
        h = h.join(state.withColumnRenamed("id", "s_"), F.col("id") == F.col("s_"))
        h = h.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        # the bin that holds the k-th; queries with fewer candidates keep the lowest bin
        h = h.withColumn("last", F.lead("bin").over(w).isNull())
        h = h.where((F.col("upto") - F.col("n") < F.col("want")) & ((F.col("upto") >= F.col("want")) | F.col("last")))
        state = cut(h.select("id", (F.col("low") + F.col("bin") * F.lit(1 << shift)).alias("low"),
                             F.when(F.col("upto") >= F.col("want"), F.col("want") - F.col("upto") + F.col("n"))
                             .otherwise(F.lit(k)).cast("long").alias("want")))

    def keep(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        ids, low = a["id"].to_numpy(), a["low"].to_numpy()
        for part, s, mask, of in _scored(a, b):
            mask &= s >= low[part, None]
            for row, score, qid in zip(mask, s, ids[part]):
                at = np.flatnonzero(row)
                at = at[np.argsort(-score[at], kind="stable")[:k]]  # ids ascend, so ties go to the smaller
                out.append((np.full(len(at), qid), of[at], score[at]))
        cols_ = zip(*out) if out else ([np.zeros(0, np.int64)],) * 3
        return pa.table([i64(np.concatenate(x)) for x in cols_], ["query_id", "vec_id", "score"])

    found = over(state, keep, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if names is not None:
        for c_ in ("query_id", "vec_id"):
            found = found.join(names, F.col(c_) == F.col("key_")).drop("key_", c_).withColumnRenamed("name_", c_)
    return found.select("query_id", "rank", "vec_id", "score")
