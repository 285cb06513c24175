"""Mixing sources to target weights, in words.

Each source's documents, in order of id, form one stream of words that is
packed into fixed-length blocks (the last one may be shorter).  The mix is a
list of slots.  Every output shard draws its source counts from a multinomial;
a source's slots are numbered through all shards, numbers beyond its quota are
void, and what the draws leave of a quota forms the last shard, so that each
source gets its quota exactly.  Slot j of a source is block P(j mod n) of its n
blocks, P being a pseudorandom permutation of that round, keyed by source and
round; slots and blocks are then joined by index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import cut, i64, map_batches, prepare
from staywise.operators.ordering import position, running_sum

WORD = r"[^\x20\x09-\x0D]+"
#: Slots that one task makes, on average.
TASK_SLOTS = 1 << 18
#: Weights by the rank of the source, repeating.
WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          row: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size): words of every row; ``row`` tells repeated rows apart."""
    row = F.monotonically_increasing_id() if row is None else row
    d = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                    F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    return d.select("row", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, rank, source_size, target): ``share`` of all words dealt by
    weight, no source above ``limit`` times its words, the excess dealt anew by
    weight among the others until none is above."""
    by = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = position(by, [F.col("source").isNull(), F.col("source")], "rank")
    deal = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", deal).withColumn("cap", F.lit(float(limit)) * F.col("source_size")))
    level, full = 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * level if full >= 0 else F.lit(False)
        total, capped, open_, n = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count(F.when(over, 1))).first()
        if n == full or not open_:
            break
        full, level = n, (share * total - capped) / open_
    return ranked.withColumn("target", F.least("cap", F.col("weight") * level)).select("source", "rank", "source_size", "target")


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position of ``i`` under a keyed pseudorandom permutation of range(n): a
    four-round Feistel network over the next even number of bits, applied again
    where it leaves the range."""
    half = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2 + 1e-12).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        h, m, x = half[todo], low[todo], out[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            f = (right + key[todo] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _draws(spark, quotas: np.ndarray, shard_slots: int, seed: int) -> DataFrame:
    """(shard, rank, n): multinomial counts of each shard, zeros left out."""
    total = int(quotas.sum())
    shards = -(-total // shard_slots)
    p = spark.sparkContext.broadcast(quotas / max(1, total))  # one number per source

    def draw(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for shard in b.column("id").to_pylist():
            slots = min(shard_slots, total - shard * shard_slots)
            n = np.random.default_rng([seed, shard]).multinomial(slots, p.value)
            at = np.flatnonzero(n)
            out.append((np.full(len(at), shard), at, n[at]))
        return pa.RecordBatch.from_arrays([i64(np.concatenate(x)) for x in zip(*out)], ["shard", "rank", "n"])

    return map_batches(spark.range(shards), draw, "shard long, rank long, n long")


def slots_of(goal: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, rank, slot, blocks): every slot of the mix, about ``TASK_SLOTS`` in a task."""
    spark = goal.sparkSession
    prepare(spark)
    goal = goal.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    goal = goal.withColumn("quota", F.when(F.col("blocks") > 0, F.round(
        F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(0).cast("long"))
    quotas = np.zeros(0, np.int64)
    got = goal.select("rank", "quota").collect()
    if got:
        quotas = np.zeros(len(got), np.int64)
        for r in got:
            quotas[r["rank"]] = r["quota"]
    drawn = running_sum(_draws(spark, quotas, shard_slots, seed), "rank", [F.col("shard")], "n", "first")
    of = goal.select(F.col("rank").alias("r_"), "blocks", "quota")
    drawn = drawn.join(of, drawn["rank"] == of["r_"]).drop("r_")
    kept = drawn.withColumn("n", F.least("n", F.col("quota") - F.col("first"))).where("n > 0")
    done = drawn.groupBy(F.col("rank").alias("r_")).agg(F.sum("n").alias("done"))
    rest = goal.join(done, goal["rank"] == done["r_"], "left").withColumn("first", F.coalesce("done", F.lit(0)))
    last = -(-int(quotas.sum()) // shard_slots)
    rest = rest.withColumn("n", F.col("quota") - F.col("first")).where("n > 0").withColumn("shard", F.lit(last).cast("long"))
    cols = ["shard", "rank", "n", "first", "blocks"]
    slots = kept.select(cols).unionByName(rest.select(cols))
    # dealt by the number of slots, not by these few rows' bytes, before they become rows
    slots = slots.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / shard_slots))))
    slots = slots.withColumn("n", F.least(F.lit(shard_slots), F.col("n") - F.col("part") * shard_slots))
    slots = slots.withColumn("first", F.col("first") + F.col("part") * shard_slots).drop("part")
    slots = slots.repartition(max(1, -(-int(quotas.sum()) // TASK_SLOTS)), "shard", "rank", "first")
    slots = slots.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    return slots.select("shard", "rank", "slot", "blocks")


def mix(rows: DataFrame, goal: DataFrame, block_words: int = 64, shard_slots: int = 8192, seed: int = 1) -> DataFrame:
    """The mix, a row per run of words: shard, slot (of the source), source
    rank, round, block, row, doc_id, from_word, n_words.

    ``rows`` from ``sizes`` (checkpointed), ``goal`` from ``targets``
    (checkpointed).  The quota of a source is its target in mean blocks, at
    most two rounds of its blocks if its target is twice its words.  One quota
    per source goes to the driver.  Documents without words take no part; an
    empty table gives an empty mix; the same rows and seed give the same mix."""
    slots = slots_of(goal, block_words, shard_slots, seed)

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        shard, rank, slot, n = (b.column(k).to_numpy() for k in ("shard", "rank", "slot", "blocks"))
        turn = slot // n
        key = (rank.astype(np.uint64) * np.uint64(1 << 20) + turn.astype(np.uint64) + np.uint64(seed << 50)) * np.uint64(0x9E3779B97F4A7C15)
        block = permuted(slot % n, n, key)
        return pa.RecordBatch.from_arrays([i64(x) for x in (shard, slot, rank, turn, block)],
                                          ["shard", "slot", "rank", "round", "block"])

    placed = map_batches(slots, place, "shard long, slot long, rank long, round long, block long")
    # both sides grow with the words: the slots' few rows before they are made must not pass for their size
    return placed.hint("merge").join(blocks(rows, goal, block_words), ["rank", "block"])


def blocks(rows: DataFrame, goal: DataFrame, block_words: int) -> DataFrame:
    """(rank, block, row, doc_id, from_word, n_words): the runs of words that fill each block."""
    of = goal.select(F.col("source").alias("s_"), "rank")
    d = rows.where("size > 0").join(of, F.col("source").eqNullSafe(F.col("s_"))).drop("s_", "source")
    d = running_sum(d, "rank", [F.col("doc_id"), F.col("size"), F.col("row")], "size", "at")
    end = F.col("at") + F.col("size")
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((end - 1) / block_words))))
    lo = F.greatest("at", F.col("block") * block_words)
    hi = F.least(end, (F.col("block") + 1) * block_words)
    return d.select("rank", "block", "row", "doc_id", (lo - F.col("at")).alias("from_word"), (hi - lo).alias("n_words"))


def taken(docs: DataFrame, block_words: int = 64, seed: int = 1, **cols: str) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words
    that the mix takes of it, repeats counted).

    Null texts have size 0; null sources form a source of their own; a null
    doc_id comes first in its source.  Repeated rows are mixed one by one."""
    rows = cut(sizes(docs, **cols))
    goal = cut(targets(rows))
    by = mix(rows, goal, block_words, seed=seed).groupBy(F.col("row").alias("row_")).agg(F.sum("n_words").alias("n_"))
    of = goal.select(F.col("source").alias("s_"), "source_size", "target")
    out = rows.join(of, rows["source"].eqNullSafe(of["s_"])).join(by, F.col("row") == F.col("row_"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("n_", F.lit(0)).cast("long").alias("taken"))


def words_between(text: bytes, runs: list[tuple[int, int]]) -> str:
    """The runs (first word, number of words) of a text, each with its own
    white space, joined by line ends; the whole text if they cover it."""
    b = np.frombuffer(text, np.uint8)
    word = np.concatenate([[False], ~((b == 32) | ((b >= 9) & (b <= 13))), [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    if len(runs) == 1 and runs[0] == (0, len(starts)):
        return text.decode("utf-8", "replace")
    return "\n".join(text[starts[a]:ends[a + n - 1]].decode("utf-8", "replace") for a, n in runs)


def _merged(runs) -> list[tuple[int, int]]:
    """Neighbouring runs as one."""
    out: list[tuple[int, int]] = []
    for r in runs:
        a, n = int(r["from_word"]), int(r["n_words"])
        if out and sum(out[-1]) == a:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((a, n))
    return out


def mixed_documents(docs: DataFrame, folder: str, block_words: int = 64, seed: int = 1) -> DataFrame:
    """The mix as documents: for each round that takes words of a document, its
    row with these words as ``text`` and their length as ``n_chars``.  The rows
    are numbered in a table written to ``folder`` (shared)."""
    spark = docs.sparkSession
    prepare(spark)
    row, taken_runs = "row_of_mix_", "runs_of_mix_"
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(folder)
    kept = spark.read.parquet(folder)
    rows = cut(sizes(kept, row=F.col(row)))
    goal = cut(targets(rows))
    runs = mix(rows, goal, block_words, seed=seed).groupBy("row", "round").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("runs"))
    runs = runs.select(F.col("row").alias(row), F.col("runs").alias(taken_runs))
    out = kept.join(runs, row)

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([words_between(t.encode(), _merged(r)) for t, r in zip(texts, runs)], dtype=object)

    out = out.withColumn("text", cut_out("text", taken_runs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
