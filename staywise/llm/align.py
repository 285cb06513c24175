"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the same bytes at different places.  Every token points to
the token that reaches farthest right among those that overlap it; where both
tokenizations end at one byte, the second one's token points to itself.
Replacing each pointer by its target's pointer doubles the distance that it
spans, so after log2(longest group) rounds every token of a component points to
the component's terminal token, which labels the group.  The tokens of many
documents are laid one after the other in one array (all documents end at a
common place), so a round is one numpy gather.

A pair of tokens that end together covers the same last bytes, so the shorter
is a suffix of the longer: the pairs that can occur in any corpus are bounded by
the two vocabularies (``pair_bound``), however large the corpus.  The
corpus-wide counts are therefore small enough to send to every task.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import i64, map_batches, pick, prepare, slices, texts_of
from staywise.session import checkpoint_dir

_GAP = re.compile(r"(?<=\S) ")
#: Distinct pairs that a task gathers before it adds them up.
GATHER = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: visible ones
    stand for themselves, the others for code points from 256 up, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in visible)
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file of the ``tokenizers`` library; a text is encoded after a space."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are plain text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.bytes = [b""] * (1 + max(spec["model"]["vocab"].values()))
        for token, k in spec["model"]["vocab"].items():
            if all(c in letters for c in token):
                self.bytes[k] = bytes(letters[c] for c in token)
        #: Does a space after a visible character always begin a new token?
        first = spec["pre_tokenizer"] or {}
        self.parts = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not spec["normalizer"]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which itself puts a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(k) for k in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if m.is_byte(k) else b"" if m.is_control(k) or m.is_unknown(k)
                      else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.parts = all("▁" not in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def tokenizer_of(path: str):
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def pair_bound(first: list[bytes], second: list[bytes]) -> int:
    """How many pairs of tokens can end together: one must be a suffix of the other."""
    count: dict[bytes, list[int]] = {}
    for side, tokens in enumerate((first, second)):
        for t in tokens:
            if t:
                count.setdefault(t, [0, 0])[side] += 1
    total = sum(a * b for a, b in count.values())
    for t, (a, b) in count.items():
        for k in range(1, len(t)):
            if other := count.get(t[k:]):
                total += a * other[1] + b * other[0]
    return total


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of both sides the second side's token that ends its
    component, by successor doubling.  Ends ascend; both reach the same last end."""
    n, m = len(ends_a), len(ends_b)
    over_a = np.searchsorted(ends_a, ends_b)  # the first side's token that holds the last byte
    successor = np.concatenate([n + np.searchsorted(ends_b, ends_a),
                                np.where(ends_a[over_a] > ends_b, over_a, n + np.arange(m))])
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor[:n] - n, successor[n:] - n
        successor = further


class Slice:
    """Aligned tokens of some documents, laid one after the other."""

    def __init__(self, ids_a: list[bytes], ids_b: list[bytes], lengths_a: np.ndarray, lengths_b: np.ndarray):
        self.n_a = np.array([len(x) // 4 for x in ids_a], np.int64)
        self.n_b = np.array([len(x) // 4 for x in ids_b], np.int64)
        self.a = np.frombuffer(b"".join(ids_a), "<u4").astype(np.int64)
        self.b = np.frombuffer(b"".join(ids_b), "<u4").astype(np.int64)
        self.ends = lengths_b[self.b].cumsum()
        end_a, end_b = terminals(lengths_a[self.a].cumsum(), self.ends)
        last = np.zeros(len(self.b), bool)
        last[end_b] = True
        number = last.cumsum() - 1  # of the group that a terminal ends
        self.group_a, self.group_b = number[end_a], number[end_b]
        self.size_a, self.size_b = np.bincount(self.group_a), np.bincount(self.group_b)
        #: The tokens of both sides that end each group.
        self.last_a, self.last_b = self.size_a.cumsum() - 1, self.size_b.cumsum() - 1
        self.document = np.searchsorted(self.n_b.cumsum(), self.last_b, side="right")  # of each group
        self.n_groups = np.bincount(self.document, minlength=len(ids_a))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the tokens that end together, in order."""
        return self.a[self.last_a], self.b[self.last_b]

    def written(self, names: list[bytes], first: int, second: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of each document; ``names``: see ``_names``."""
        both = self.size_a + self.size_b
        at = both.cumsum() - both
        code = np.empty(len(self.a) + len(self.b), np.int64)
        last = np.zeros(len(self.a), np.int64)
        last[self.last_a] = 1
        code[at[self.group_a] + np.arange(len(self.a)) - (self.last_a + 1 - self.size_a)[self.group_a]] = self.a + first * last
        last = np.zeros(len(self.b), np.int64)
        last[self.last_b] = 1
        at = at + self.size_a
        code[at[self.group_b] + np.arange(len(self.b)) - (self.last_b + 1 - self.size_b)[self.group_b]] = 2 * first + self.b + second * last
        out, lo = [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(b"".join([names[k] for k in code[lo:lo + n].tolist()])[:-1])
            lo += n
        return out


def _names(first: int, second: int) -> list[bytes]:
    """An id and what follows it: the first side's ids inside a group and last in it, then the second's."""
    return [b"%d%s" % (k, end) for n, ends in ((first, (b",", b"|")), (second, (b",", b";"))) for end in ends for k in range(n)]


class Aligner:
    """Both tokenizers.  No token of either reaches over a space behind a visible
    character, so a text is the sequence of its parts between such spaces, and a
    worker encodes each distinct part once (the more recent half of its memory
    stays when that is full).  Where a vocabulary has such tokens, texts are encoded whole."""

    def __init__(self, first: str, second: str, memory: int = 300_000):
        self.first, self.second = tokenizer_of(first), tokenizer_of(second)
        self.sizes = len(self.first.bytes), len(self.second.bytes)
        self.lengths = [np.array([len(t) for t in side.bytes], np.int64) for side in (self.first, self.second)]
        self.names = _names(*self.sizes)
        self.parts = self.first.parts and self.second.parts
        self.memory, self.recent, self.older = memory, {}, {}

    def split(self, text: str) -> list[str]:
        if not self.parts:
            return [text]
        parts = _GAP.split(text)
        if not parts[-1]:  # a last space is encoded behind what it follows
            parts[-2:] = [parts[-2] + " "]
        return parts

    def _learn(self, wanted: set[str]) -> None:
        """Ids of both sides of each part (4 bytes an id); none if either does not spell it."""
        if len(self.recent) > self.memory:
            self.older, self.recent = self.recent, {}
        new = wanted.difference(self.recent)
        for part in [p for p in new if p in self.older]:
            self.recent[part] = self.older[part]
        new = [p for p in new if p not in self.recent]
        for part, a, b in zip(new, self.first.encode(new), self.second.encode(new)):
            data = b" " + part.encode()
            spelled = self._spells(self.first, a, data) and self._spells(self.second, b, data)
            self.recent[part] = (np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()) if spelled else None

    @staticmethod
    def _spells(side, ids: list[int], data: bytes) -> bool:
        """Do the tokens spell the bytes, each at least one?"""
        tokens = [side.bytes[k] for k in ids]
        return all(tokens) and b"".join(tokens) == data

    def slices(self, texts: list[bytes | None]) -> Iterator[tuple[list[int], Slice]]:
        """(places of the documents that have tokens, their slice)."""
        held = [t or b"" for t in texts]
        for part in slices(held, 512, 1 << 20):
            split = [self.split(s) if t and (s := _decoded(t)) else [] for t in held[part]]
            self._learn(set().union(*split))
            kept, a, b = [], [], []
            for k, parts in enumerate(split, part.start):
                ids = [self.recent[p] for p in parts]
                if ids and None not in ids:
                    kept.append(k)
                    a.append(b"".join([x for x, _ in ids]))
                    b.append(b"".join([y for _, y in ids]))
            if kept:
                yield kept, Slice(a, b, *self.lengths)


def _decoded(text: bytes) -> str:
    try:
        return text.decode()
    except UnicodeDecodeError:
        return ""  # cannot be spelled


@lru_cache(maxsize=2)
def aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def groups(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group: doc_id, group (from 0), end (of its bytes, the space
    before the text counted), a, b (ids of both tokenizers).  Documents without
    tokens (see ``alignment``) have no rows."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        tool = aligner(first, second)
        ids, out = b.column("doc_id").to_pylist(), []
        for places, s in tool.slices(b.column("text").to_pylist()):
            before = np.concatenate([[0], s.ends[s.n_b.cumsum() - 1]])
            start = np.concatenate([[0], s.n_groups.cumsum()])
            out += [(ids[places[d]], g - start[d], s.ends[y - 1] - before[d], s.a[x - p:x].tolist(), s.b[y - q:y].tolist())
                    for g, (d, x, y, p, q) in enumerate(zip(s.document, s.last_a + 1, s.last_b + 1, s.size_a, s.size_b))]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                          ["doc_id", "group", "end", "a", "b"]) if out else None

    return map_batches(_rows(docs, id_col, text_col), run, "doc_id long, group long, end long, a array<int>, b array<int>")


def linked(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, and its distinct linked id pairs with how often each occurs
    (``pairs``: a * size of the second vocabulary + b, ascending, 8 bytes each;
    ``times``: 4 bytes each; little-endian)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        tool, rows = aligner(first, second), b.num_rows
        counts = np.zeros((3, rows), np.int64)
        digests, pairs, times = [""] * rows, [b""] * rows, [b""] * rows
        for places, s in tool.slices(b.column("text").to_pylist()):
            counts[:, places] = s.n_a, s.n_b, s.n_groups
            x, y = s.links()
            code = x * tool.sizes[1] + y
            order = np.lexsort((code, s.document))
            code, document = code[order], s.document[order]
            head = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (document[1:] != document[:-1])]))
            many = np.diff(np.append(head, len(code))).astype("<u4")
            code, edge = code[head].astype("<i8"), np.searchsorted(document[head], np.arange(len(places) + 1))
            for k, (place, text) in enumerate(zip(places, s.written(tool.names, *tool.sizes))):
                digests[place] = hashlib.sha256(text).hexdigest()
                pairs[place], times[place] = code[edge[k]:edge[k + 1]].tobytes(), many[edge[k]:edge[k + 1]].tobytes()
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *map(pa.array, counts), pa.array(counts[2]), pa.array(digests), pa.array(pairs, pa.binary()),
             pa.array(times, pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return map_batches(_rows(docs, id_col, text_col), run,
                       "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def _summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(times), len(code)).astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many links of the whole corpus hold each pair; a task adds its own up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for b in batches:
            codes.append(np.frombuffer(b"".join(texts_of(b.column("pairs"))), "<i8"))
            times.append(np.frombuffer(b"".join(texts_of(b.column("times"))), "<u4").astype(np.int64))
            held += len(codes[-1])
            if held > GATHER:
                code, n = _summed(codes, times)
                codes, times, held = [code], [n], 0
        code, n = _summed(codes, times)
        if len(code):
            yield pa.RecordBatch.from_arrays([i64(code), i64(n)], ["pair", "n"])

    return rows.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links
    whose count is their second id's highest in the corpus, ties included),
    count_sum (of the counts of all links), groups_sha256.

    Texts that are null, empty, not valid UTF-8, or that either tokenizer's
    tokens do not spell byte by byte (behind one space) have no tokens: zeros
    and an empty digest.  Null ids and repeated rows are rows like any other
    (a repeated row's links count again).  Empty tables give an empty result;
    no other column is read.

    Texts are encoded once; the links go to a table in the shared folder, which
    is read for the counts and again for the sums."""
    spark = docs.sparkSession
    prepare(spark)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/aligned-{uuid.uuid4().hex}"
    linked(docs, first, second, id_col, text_col).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)
    tool = aligner(first, second)
    size = tool.sizes[1]
    found = pair_counts(rows).toArrow()  # at most pair_bound rows, whatever the corpus
    order = np.argsort(found["pair"].to_numpy())
    code, n = found["pair"].to_numpy()[order], found["n"].to_numpy()[order]
    highest = np.zeros(size, np.int64)
    np.maximum.at(highest, code % size, n)
    best = n == highest[code % size]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pairs, times = texts_of(b.column("pairs")), texts_of(b.column("times"))
        at = np.searchsorted(code, np.frombuffer(b"".join(pairs), "<i8"))
        many = np.frombuffer(b"".join(times), "<u4").astype(np.int64)
        edge = np.concatenate([[0], np.cumsum([len(x) // 8 for x in pairs])])
        sums = [np.concatenate([[0], x.cumsum()]) for x in (many * best[at], many * n[at])]
        kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[i64(s[edge[1:]] - s[edge[:-1]]) for s in sums], b.column("groups_sha256")],
                                          [*kept, "n_best", "count_sum", "groups_sha256"])

    return map_batches(rows, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
