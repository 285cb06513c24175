"""Embedding near-duplicates: randomised-rotation binary codes.

Each unit vector is rotated by a random orthogonal matrix and coded by signs;
the stored correction factor (inner product of code and vector) makes the
code's inner product with another rotated vector, itself quantised with random
rounding, an unbiased estimate of the cosine with a known error bound.  Only
pairs whose upper bound reaches the threshold are computed exactly, in double
precision.

Pairs to estimate come from buckets of random hyperplane signs: as many tables
as bring a pair at the threshold itself together with probability ``recall``
(closer pairs more surely).  The number of signs grows with the table, so that
buckets stay about as large, and the number of tables follows from it.  A pair
is counted in its first common table only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import count_rows, cut, i64, map_batches, pick, prepare
from staywise.llm.components import connected_components
from staywise.llm.tiles import pair_chunks, stars, work_groups
from staywise.llm.topk import usable

PLANES = 4
#: Standard deviations kept on each side of an estimate.
SIGMAS = 4.0


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """dim x bits with orthonormal rows: a random rotation of the zero-padded space."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, bits]).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


@lru_cache(maxsize=4)
def hyperplanes(dim: int, tables: int, signs: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, 1, dim]).standard_normal((dim, tables * signs))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(signs a table, tables) for n vectors."""
    signs = int(min(56, max(1, np.ceil(np.log2(max(n, 2))) - 9)))
    meet = (1 - np.arccos(threshold) / np.pi) ** signs
    return signs, max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - meet)))) if meet < 1 else 1


def record(dim: int, bits: int, tables: int, real: str) -> np.dtype:
    words = bits // 64
    return np.dtype([("id", "<i8"), ("copies", "<i8"), ("factor", "<f4"), ("low", "<f4"), ("step", "<f4"), ("sum", "<f4"),
                     ("ones", "<f4"), ("code", "<u8", (words,)), ("planes", "<u8", (PLANES, words)),
                     ("keys", "<i8", (tables,)), ("vec", real, (dim,))])


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def encode(ids: np.ndarray, copies: np.ndarray, v: np.ndarray, kind: np.dtype, bits: int, tables: int, signs: int, seed: int) -> np.ndarray:
    out = np.zeros(len(v), kind)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    r = unit @ rotation(v.shape[1], bits, seed)
    out["id"], out["copies"], out["vec"] = ids, copies, v
    out["factor"] = np.abs(r).sum(axis=1) / np.sqrt(bits)
    out["code"], out["ones"] = _packed(r > 0), (r > 0).sum(axis=1)
    low = r.min(axis=1, keepdims=True)
    step = np.maximum((r.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-12)
    # random rounding, seeded by each vector's id, keeps the estimate unbiased
    noise = np.stack([np.random.default_rng([seed, 2, int(i) & (1 << 63) - 1]).random(bits) for i in ids]) if len(ids) else r
    level = np.minimum(np.floor((r - low) / step + noise), 2**PLANES - 1).astype(np.uint8)
    out["low"], out["step"], out["sum"] = low[:, 0], step[:, 0], level.sum(axis=1)
    out["planes"] = np.stack([_packed((level >> p) & 1) for p in range(PLANES)], axis=1)
    side = ((unit @ hyperplanes(v.shape[1], tables, signs, seed)) > 0).reshape(len(v), tables, signs)
    weight = np.int64(1) << np.arange(signs, dtype=np.int64)
    out["keys"] = (side * weight).sum(axis=2) ^ (np.arange(tables, dtype=np.int64) << np.int64(56))
    return out


def upper(r: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Upper confidence bound of the cosine of pairs, from code i and the quantised j."""
    both = np.zeros(len(i), np.int64)
    code = r["code"][i]
    for p in range(PLANES):
        both += np.bitwise_count(code & r["planes"][j, p]).sum(axis=1, dtype=np.int64) << p
    f, step, low = r["factor"][i], r["step"][j], r["low"][j]
    inner = (2 * (step * both + low * r["ones"][i]) - (step * r["sum"][j] + low * bits)) / np.sqrt(bits)
    spread = np.sqrt(np.maximum(0, 1 - f * f) / (bits - 1)) + step / 2
    return (inner + SIGMAS * spread) / f


def cosines(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = r["vec"][i].astype(np.float64), r["vec"][j].astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _links(distinct: DataFrame, dim: int, threshold: float, recall: float, seed: int, tile_rows: int, group_rows: int) -> DataFrame:
    """``distinct``: (id, copies, v) of one length.  (a, b, n): for b null, n
    vectors linked to a were found in some work group; else a spanning link."""
    n = count_rows(distinct)
    signs, tables = plan(n, threshold, recall)
    bits = 64 * max(2, -(-dim // 64))
    real = "<f4" if dict(distinct.dtypes)["v"] == "array<float>" else "<f8"
    kind = record(dim, bits, tables, real)

    def code(b: pa.RecordBatch) -> pa.RecordBatch:
        v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        r = encode(b.column("id").to_numpy(), b.column("copies").to_numpy(), v, kind, bits, tables, signs, seed)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * tables, pa.int32()), i64(r["keys"].ravel()))
        return pa.RecordBatch.from_arrays([b.column("id"), keys, pa.array([x.tobytes() for x in r], pa.binary())], ["spread", "keys", "data"])

    coded = cut(map_batches(distinct, code, "spread long, keys array<long>, data binary"))
    rows = coded.select("spread", "data", F.posexplode("keys").alias("table", "bucket"))
    groups = work_groups(rows, tile_rows, group_rows)

    def compare(t: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(t["data"].to_pylist()), kind)
        bucket, side, table = (t[x].to_numpy() for x in ("bucket", "side", "table"))
        order = np.lexsort((bucket, side))
        r, bucket, side, table = r[order], bucket[order], side[order], table[order]
        u, v, count = [], [], np.zeros(len(r), np.int64)
        for i, j in pair_chunks(bucket, side, 1 << 18):
            near = upper(r, i, j, bits) >= threshold
            i, j = i[near], j[near]
            sure = cosines(r, i, j) >= threshold
            i, j = i[sure], j[sure]
            # seen in an earlier table?
            first = ~((r["keys"][i] == r["keys"][j]) & (np.arange(tables) < table[i][:, None])).any(axis=1)
            i, j = i[first], j[first]
            np.add.at(count, i, r["copies"][j])
            np.add.at(count, j, r["copies"][i])
            a, b = stars(r["id"][i], r["id"][j])
            u.append(a)
            v.append(b)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
        a, b = stars(a, b)
        some = np.flatnonzero(count)
        return pa.table({"a": pa.concat_arrays([i64(a), i64(r["id"][some])]),
                         "b": pa.concat_arrays([i64(b), pa.nulls(len(some), pa.int64())]),
                         "n": pa.concat_arrays([i64(np.zeros(len(a), np.int64)), i64(count[some])])})

    return groups.select("work", "side", "bucket", "table", "data").groupBy("work").applyInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, seed: int = 3, tile_rows: int = 2048,
                    group_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked directly),
    component_id (least id reachable, itself included), kept (vec_id = component_id).

    Vectors that are null, all zero, hold a null or non-finite component or
    have no id link with nothing and are their own component (null without an
    id); vectors of different lengths do not link.  Equal vectors are compared
    once and always link; repeated rows are copies of each other."""
    prepare(vectors.sparkSession)
    d = pick(vectors, id=id_col, v=vector_col).withColumn("id", F.col("id").cast("long"))
    if dict(d.dtypes)["v"] != "array<float>":
        d = d.withColumn("v", F.col("v").cast("array<double>"))
    ok = F.col("id").isNotNull() & usable("v") & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    good = d.where(ok)
    distinct = cut(good.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    found = None
    for r in distinct.select(F.size("v").alias("dim")).distinct().collect():  # one length, as a rule
        some = _links(distinct.where(F.size("v") == r["dim"]), r["dim"], threshold, recall, seed, tile_rows, group_rows)
        found = some if found is None else found.unionByName(some)
    alone = d.where(~ok).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                                F.coalesce(F.col("id").isNotNull(), F.lit(False)).alias("kept"))
    if found is None:
        return alone
    found = cut(found)
    comp = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("l_")).agg(F.sum("n").alias("n"))
    named = distinct.join(comp, F.col("id") == F.col("node"), "left").join(links, F.col("id") == F.col("l_"), "left")
    named = named.select(F.col("v").alias("v_"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
                         F.coalesce("component", "id").alias("component_id"))
    out = good.join(named, F.col("v") == F.col("v_")).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)
