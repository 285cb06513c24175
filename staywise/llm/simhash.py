"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked when
they differ in at most ``radius`` bits, by tiled exact comparison in numpy.

Every pair of fingerprints within the radius agrees on at least
``parts - radius`` of ``parts`` equal slices of its bits, so comparing only
inside buckets of agreeing slices loses no link.  Inside a bucket the
comparison is exact (exclusive-or and bit count); buckets larger than a tile
are cut into tiles of one population count each, and tile pairs whose counts
differ by more than the radius are skipped, because fingerprints within r bits
differ by at most r in population count.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import count_rows, cut, i64, map_batches, pick, texts_of
from staywise.llm.components import connected_components
from staywise.llm.tiles import pair_chunks, stars, work_groups

SEED = 42


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words; one hash of a shorter sequence, none of an empty one."""
    from xxhash import xxh64_intdigest as xx

    if len(words) > size:
        runs = zip(*[words[k:] for k in range(size)])
        return np.fromiter((xx(b" ".join(r), SEED) for r in runs), np.uint64, len(words) - size + 1)
    return np.array([xx(b" ".join(words), SEED)] if words else [], np.uint64)


def fingerprint(text: bytes, size: int) -> int:
    """Each bit set in over half of the hashes of all shingles, repeats included."""
    h = shingle_hashes(text.lower().split(), size)  # bytes: A-Z and ASCII white space only
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash long, fp long) for every row; a null or wordless text has fingerprint 0."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x, shingle_words) for x in texts_of(b.column("text"))], np.uint64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), i64(fp)], ["doc_id", "text_hash", "fp"])

    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id long, text_hash long, fp long")


def slicing(n: int, radius: int, bits: int = 64) -> list[list[tuple[int, int]]]:
    """Bit slices whose agreement makes a bucket, by the number of fingerprints:
    more slices, and buckets of several, as the table grows, so that a bucket
    of evenly spread fingerprints stays about as large."""
    want = max(1.0, np.log2(max(n, 2)) - 7)
    for parts in range(radius + 1, bits + 1):
        edges = [round(bits * k / parts) for k in range(parts + 1)]
        agree = parts - radius
        if agree * (bits // parts) >= want or parts >= radius + 6:
            return [[(edges[k], edges[k + 1]) for k in pick_] for pick_ in combinations(range(parts), agree)]
    return [[(0, bits)]]


def links(fps: DataFrame, radius: int = 4, tile_rows: int = 2048, group_rows: int = 50_000) -> DataFrame:
    """``fps``: distinct fingerprints (column fp).  Returns links (a, b) whose
    components are those of all pairs within ``radius`` bits: a spanning forest
    per work group, not the pairs."""
    n = count_rows(fps)
    keys = []
    for k, slices in enumerate(slicing(n, radius)):
        mask = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in slices)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask))))
    rows = fps.select("fp", F.col("fp").alias("spread"), F.bit_count("fp").alias("ones"),
                      F.explode(F.array(*keys)).alias("bucket"))
    groups = work_groups(rows, tile_rows, group_rows, level="ones", reach=radius)

    def compare(t: pa.Table) -> pa.Table:
        fp = t["fp"].to_numpy().view(np.uint64)
        bucket, side = t["bucket"].to_numpy(), t["side"].to_numpy()
        order = np.lexsort((bucket, side))
        fp, bucket, side = fp[order], bucket[order], side[order]
        found = [(fp[i[near]], fp[j[near]]) for i, j in pair_chunks(bucket, side)
                 if (near := np.bitwise_count(fp[i] ^ fp[j]) <= radius).any()]
        u, v = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64),) * 2
        a, b = stars(u.view(np.int64), v.view(np.int64))
        return pa.table({"a": i64(a), "b": i64(b)})

    return groups.select("work", "side", "bucket", "fp").groupBy("work").applyInArrow(compare, "a long, b long")


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, c, least): the component of each fingerprint of ``rows`` (named by
    a fingerprint) and the least id that has it."""
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = connected_components(links(nodes.select("fp"), radius))
    return nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", F.coalesce("component", "fp").alias("c"), "least")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, radius: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp long, component_id (the least doc_id
    reachable by links of at most ``radius`` differing bits, itself included).

    Null and empty texts share fingerprint 0 and link like any other.  Equal
    texts and repeated rows share a fingerprint, so they share a component.  A
    row with a null doc_id keeps its fingerprint and gets its group's least
    non-null id (null if there is none).  Empty tables give an empty result;
    other columns are not read."""
    rows = cut(fingerprints(docs, shingle_words, id_col, text_col))
    named = _grouped(rows, radius)
    ids = named.groupBy("c").agg(F.min("least").alias("component_id"))
    label = named.select("fp", "c").join(ids, "c").select(F.col("fp").alias("fp_"), "component_id")
    return rows.join(label, rows["fp"] == label["fp_"], "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns, of each group of near-duplicates: that of the least
    id (rows without an id come last), of several with this id that of the
    least text hash.

    Groups are those of texts, whatever the ids: different texts under one id
    each stay if nothing else resembles them, and a row without an id stays if
    its group has no other.  Of rows equal in id and text one stays (any)."""
    rows = cut(fingerprints(docs, shingle_words, id_col, text_col))
    named = _grouped(rows, radius)
    # the first row of each fingerprint, then of each component: both add up before they move
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first"))
    kept = first.withColumnRenamed("fp", "fp_").join(named.select("fp", "c"), F.col("fp_") == F.col("fp"))
    kept = cut(kept.groupBy("c").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash"))
    key = [F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("doc_of_group_")), F.xxhash64(F.col(f"`{text_col}`")) == F.col("hash_of_group_")]
    wanted = kept.select(F.col("doc_id").alias("doc_of_group_"), F.col("text_hash").alias("hash_of_group_"))
    out = docs.join(wanted, key[0] & key[1], "left_semi").select(docs.columns)
    repeated = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc_of_group_")) & (F.col("text_hash") == F.col("hash_of_group_")), "left_semi")
    if count_rows(repeated) > count_rows(kept):  # some kept row occurs more than once
        out = out.groupBy(F.col(f"`{id_col}`").cast("long").alias("id_of_group_"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash_of_group_")).agg(
            F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row_of_group_")).select("row_of_group_.*")
    return out
