"""Ranked lexical search: hashed max-sketches, batched upper bounds, exact
rescoring in descending order of the bounds.

Terms are hashed to the coordinates of a wide sketch.  A document's sketch
holds, at each coordinate, the greatest impact of its terms that fall there, so
a query's weights times the sketch can only overrate the document.  A block of
sketches is looked up for a block of queries at once (one matrix product over
the coordinates that the queries use); then each query's documents are rescored
exactly from the greatest bound down, until the next bound is below the query's
k-th score so far.  A task carries these thresholds from block to block, so
after the first blocks few documents are rescored.  Tasks share nothing: what
they keep (k rows a query) is merged by two small shuffles, and a lost task is
simply run again.

All arithmetic of scores is integer; bounds are sums of integers below 2**53 in
doubles, so they are exact too.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staywise.llm.common import pick, prepare, slices, texts_of

#: Coordinates of a sketch.
WIDTH = 1 << 16
#: Queries go to the tasks in batches of about this many rows and bytes of text.
BATCH_ITEMS, BATCH_BYTES = 4096, 8 << 20
#: Queries looked up together, and cells of a block of sketches.
QUERY_BLOCK, CELLS = 512, 1 << 21
#: Rows of a task's salted first merge.
SALTS = 64
#: Distinct terms whose coordinates a worker remembers.
MEMORY = 500_000

# ASCII letters in lower case, digits and every byte past ASCII stay; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters past ASCII; only A-Z are lower-cased."""
    return text.translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(tf, m):
    """What an occurrence count adds for each unit of weight; grows with ``tf``."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norm(n: int, documents: int, total: int) -> int:
    return 100 - 75 + (75 * n * documents) // total


class Coordinates(dict):
    """Term -> coordinate, remembered up to a bound."""

    def __init__(self, width: int):
        super().__init__()
        self.width = width

    def __missing__(self, term: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMORY:
            self.clear()
        self[term] = at = xxh64_intdigest(term) % self.width
        return at


def _statistics(docs: DataFrame, wanted: frozenset[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, their terms in all, and of the wanted terms the
    documents that hold each: one partial row per task and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, total, held = 0, 0, Counter()
        for b in batches:
            for text in texts_of(b.column("text")):
                words = terms_of(text)
                documents, total = documents + bool(words), total + len(words)
                held.update(wanted.intersection(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *held], pa.binary()), pa.array([documents, *held.values()], pa.int64()),
             pa.array([total] + [0] * len(held), pa.int64())], ["term", "n", "total"])

    rows = docs.select("text").mapInArrow(run, "term binary, n long, total long")
    rows = rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    counts = {None if r["term"] is None else bytes(r["term"]): r["n"] for r in rows}
    return counts.pop(None, 0), sum(r["total"] for r in rows), counts


class Query:
    """Terms of one query with weight times occurrences."""

    def __init__(self, number: int, item_id, words: dict[bytes, int], weights: dict[bytes, int]):
        self.number, self.item_id = number, item_id
        self.terms = [(t, n * weights[t]) for t, n in words.items()]

    def score(self, tf: Counter, m: int) -> int:
        return sum(w * impact(tf[t], m) for t, w in self.terms if t in tf)


class Block:
    """Queries that are looked up together: their weights by sketch coordinate."""

    def __init__(self, queries: list[Query], coordinates: Coordinates, cells: int = CELLS):
        self.queries = queries
        at = [[coordinates[t] for t, _ in q.terms] for q in queries]
        used = sorted(set().union(*at))
        self.column = np.full(coordinates.width, -1, np.int64)
        self.column[used] = np.arange(len(used))
        self.weights = np.zeros((len(used), len(queries)))
        for k, (q, cs) in enumerate(zip(queries, at)):
            for (_, w), c in zip(q.terms, cs):
                self.weights[self.column[c], k] += w
        self.rows = max(1, cells // max(1, len(used)))

    def bounds(self, row: np.ndarray, coordinate: np.ndarray, impacts: np.ndarray, rows: int) -> np.ndarray:
        """Upper bounds (documents x queries) of a block of sketches."""
        column = self.column[coordinate]
        hit = column >= 0
        sketch = np.zeros(rows * len(self.weights))
        np.maximum.at(sketch, row[hit] * len(self.weights) + column[hit], impacts[hit].astype(np.float64))
        return sketch.reshape(rows, -1) @ self.weights


class Best:
    """The k best (score, id) of one query so far; ties to the smaller id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """Bounds below this cannot enter; one is the least score that counts."""
        return max(1, -self.rows[-1][0]) if len(self.rows) == self.k else 1

    def offer(self, score: int, doc_id) -> None:
        if score > 0:
            insort(self.rows, (-score, doc_id is None, 0 if doc_id is None else doc_id))
            del self.rows[self.k:]


def _searched(queries: list[Query], documents: int, total: int, k: int, width: int, cells: int, query_block: int):
    """The pass over documents: (number, item_id, doc_id, score), k rows a query and task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinates = Coordinates(width)
        blocks = [Block(queries[at:at + query_block], coordinates, cells) for at in range(0, len(queries), query_block)]
        best = {q.number: Best(k) for q in queries}
        step = min(b.rows for b in blocks)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), texts_of(b.column("text"))
            for part in slices(texts, step):
                search(ids[part], [terms_of(t) for t in texts[part]], coordinates, blocks, best)
        out = [(q.number, q.item_id, None if unnamed else doc, -score) for q in queries for score, unnamed, doc in best[q.number].rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["number", "item_id", "doc_id", "score"])

    def search(ids: list, words: list[list[bytes]], coordinates: Coordinates, blocks: list[Block], best: dict[int, Best]) -> None:
        tf = [Counter(w) for w in words]
        m = [length_norm(len(w), documents, total) if w else 0 for w in words]
        sizes = [len(c) for c in tf]
        coordinate = np.fromiter((coordinates[t] for c in tf for t in c), np.int64, sum(sizes))
        counts = np.fromiter((n for c in tf for n in c.values()), np.int64, sum(sizes))
        row = np.repeat(np.arange(len(tf)), sizes)
        impacts = impact(counts, np.array(m, np.int64)[row])
        for block in blocks:
            bounds = block.bounds(row, coordinate, impacts, len(tf))
            least = np.array([best[q.number].least for q in block.queries])
            for j in np.flatnonzero((bounds >= least).any(axis=0)).tolist():
                q, own, column = block.queries[j], best[block.queries[j].number], bounds[:, j]
                near = np.flatnonzero(column >= own.least)
                for i in near[np.argsort(-column[near], kind="stable")].tolist():
                    if column[i] < own.least:
                        break
                    own.offer(q.score(tf[i], m[i]), ids[i])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: per salt first, so that one query's rows of all tasks do not meet in one."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("number", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)


def search(documents: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, cells: int = CELLS,
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """(item_id, rank int, doc_id, score long): the k highest-scoring documents
    of every query with a score above 0 (all, if fewer), equal scores by
    ascending doc_id, null ids last.

    Null texts have no terms; a query without terms, or whose terms no document
    holds, has no rows.  Every document row counts by itself, so repeated rows
    take a rank each; queries equal in id and text are one query, and queries
    that share only an id are ranked each by itself.  Empty tables give an empty
    result.  No other column is read.

    The distinct queries go to the tasks in batches of about ``BATCH_ITEMS``
    rows and ``BATCH_BYTES`` of text, dealt by hash; each batch is two passes
    over the documents (statistics of its terms, search).  ``width`` is the
    number of sketch coordinates: fewer loosen the bounds, never the result."""
    prepare(documents.sparkSession)
    docs = pick(documents, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    items = pick(queries, item_id=item_col, text=item_text_col).select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where(F.length("text") > 0).distinct()
    rows, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    batches = max(1, -(-rows // BATCH_ITEMS), -(-size // BATCH_BYTES))
    out = documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for batch in range(batches if rows else 0):
        own = items if batches == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == batch)
        asked = [(r["item_id"], Counter(terms_of(bytes(r["text"])))) for r in own.collect()]
        n, total, held = _statistics(docs, frozenset().union(*[words for _, words in asked]))
        weights = {t: weight(n, d) for t, d in held.items()}
        able = [Query(at, item, {t: c for t, c in words.items() if t in weights}, weights) for at, (item, words) in enumerate(asked)]
        if able := [q for q in able if q.terms]:
            found = docs.mapInArrow(_searched(able, n, total, k, width, cells, query_block), "number long, item_id long, doc_id long, score long")
            out = out.unionByName(_ranked(found, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
