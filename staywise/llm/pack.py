"""Best-fit packing of tokenized documents into fixed-size sequences.

Documents longer than a sequence are cut; all pieces are dealt by hash into
groups of bounded size, and each group is packed by best-fit decreasing: a
segment tree over the remaining capacities finds the tightest open sequence
that still takes the piece in logarithmic time.  Pieces as long as a sequence
fill one each.  Lengths are spread alike over groups, so a group leaves only its
last sequences unfilled.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import count_rows, cut, i64, map_batches, pick, texts_of

#: Words, and parts of words, kept with their ids in a worker; beyond it the
#: less recent half is dropped.
MEMO_WORDS = 300_000

# letters, then ASCII punctuation: two parts that the word pattern splits alike
_LETTERS = re.compile(rb"([A-Za-z\x80-\xff]+)([!-/:-@\[-`{-~]*)").fullmatch


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself
    if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class WordTokens:
    """Ids of a text by a tokenizer that never joins or looks across ASCII
    white space, as little-endian unsigned 32-bit bytes: each distinct word is
    encoded once, and of a plain word (Latin letters, then punctuation) each
    distinct lower-cased part."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lower = kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"
        self.letters = byte_letters()
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _whole(self, w: bytes) -> bytes:
        ids = self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, letters: bytes) -> bytes | None:
        """Of one run of letters; None if it is not plain."""
        text = letters.decode("utf-8", "replace")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).lower()
            # past Latin, or a lower case that is no letter: the tokenizer's own tables decide
            if max(text) >= "\u0250" or not text.isalpha():
                return None
            text = "".join([self.letters[b] for b in text.encode()])
        ids = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, w: bytes) -> bytes:
        m = _LETTERS(w) if self.lower else None
        if m is None:
            return self._whole(w)
        letters, marks = m[1].lower(), m[2]
        ids = self.parts.get(letters)
        if ids is None:
            if (ids := self._part(letters)) is None:
                return self._whole(w)
            if len(self.parts) >= MEMO_WORDS:
                self.parts.clear()
            self.parts[letters] = ids
        if not marks:
            return ids
        tail = self.parts.get(marks)
        if tail is None:
            tail = self.parts[marks] = self._whole(marks)
        return ids + tail

    def learn(self, words: set[bytes]) -> None:
        if len(self.memo) > MEMO_WORDS // 2:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        for w in words:
            if w not in memo:
                ids = older.get(w)
                memo[w] = self._word(w) if ids is None else ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        self.learn(set().union(*words))
        memo = self.memo
        return [b"".join([memo[w] for w in ws]) for ws in words]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, slice_rows: int = 64,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, then
    ``end_id``, cut into pieces of ``capacity``; null texts have only ``end_id``."""
    last = np.array([end_id], "<u4").tobytes()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        tok = word_tokens(tokenizer)
        ids, texts = b.column("doc_id").to_pylist(), texts_of(b.column("text"))
        out: list[tuple] = []
        for at in range(0, len(texts), slice_rows):
            for doc, data in zip(ids[at:at + slice_rows], tok.encode(texts[at:at + slice_rows])):
                data += last
                for k, lo in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[lo:lo + 4 * capacity]
                    out.append((doc, k, lo // 4, len(part) // 4, zlib.crc32(part)))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
            ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"),
                                                           F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Capacities:
    """Segment tree over remaining capacities 0..capacity: open sequences by
    what they can still take."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)  # has the subtree an open sequence?
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        k = room + self.width
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest open sequence with at least ``need`` room."""
        k = need + self.width
        while not self.any[k]:
            while k & 1:  # a right child: its parent's range holds nothing further right
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.width:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        room = k - self.width
        sequence = self.open[room].pop()
        if not self.open[room]:
            self.any[k] = 0
            k >>= 1
            while k and not (self.any[2 * k] or self.any[2 * k + 1]):
                self.any[k] = 0
                k >>= 1
        return room, sequence


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each piece; lengths must not increase."""
    tree, made = Capacities(capacity), 0
    sequences, offsets = [], []
    for n in lengths:
        found = tree.take(n)
        if found is None:
            room, sequence = capacity, made
            made += 1
        else:
            room, sequence = found
        sequences.append(sequence)
        offsets.append(capacity - room)
        if room > n:
            tree.put(room - n, sequence)
    return sequences, offsets


def pack(rows: DataFrame, capacity: int = 2048, group_pieces: int = 65536) -> DataFrame:
    """``rows`` from ``pieces`` (checkpointed).  Adds sequence_id (group and
    number in it) and offset.  An empty table gives an empty result; equal
    pieces are told apart by nothing and need not be."""
    groups = max(1, -(-count_rows(rows) // group_pieces))
    dealt = rows.withColumn("part_", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit(t["length"].to_pylist(), capacity)
        of = t["part_"].to_numpy() * (1 << 32) + np.array(sequence, np.int64)
        return t.drop(["part_"]).append_column("sequence_id", i64(of)).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("part_").applyInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, **cols: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id.  Null ids and repeated rows
    are packed like any other row; other columns are not read."""
    return pack(cut(pieces(docs, tokenizer, capacity, **cols)), capacity)
