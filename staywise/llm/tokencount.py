"""Token counts by finite-state tokenizer compilation.

A merge-rule tokenizer is compiled, state by state as texts need it, into a
deterministic transducer over the symbols of a word.  Each transition carries
the number of tokens by which the word's count changes; the final symbol's
transition also returns to the start state.  A chunk of text is then a map on
the states in which it can be entered; maps of neighbouring chunks compose
associatively, and a parallel prefix scan of them gives the count of a text of
any length.

Why finitely many states suffice: the tokens of every prefix of a word begin
with the tokens of a shorter prefix, so a prefix is described by its last token
and the prefix before it.  A last token is recognised by where it starts and by
whether it may follow the last token there, so a state needs, for the starts
from which the text so far can still grow into a token, the text since the
start, the token that ends there and the count there relative to the present.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import i64, map_batches, pick, texts_of

END = "</w>"
#: Distinct words whose whole map is kept in a worker; beyond it the memory starts afresh.
MEMO_WORDS = 400_000
MEMO_BYTES = 64
#: Compiled states that a worker holds; beyond it they are compiled anew.
MOST_STATES = 200_000
SPACE = b" \t\n\r\v\f"
#: Bytes of a chunk.
CHUNK = 1 << 16

_ASCII = re.compile(rb"[!-~]+").fullmatch
#: The tokenizer file's own word pattern, for ASCII (checked against the file).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall

# (start text, last token there, relative count), longest start first
State = tuple[tuple[str, str, int], ...]


class Transducer:
    """The compiled merge rules.  ``step[s][c]`` is (next state, count change)
    for a symbol inside a word, ``last[s][c]`` the change for a final symbol."""

    def __init__(self, merges: list[tuple[str, str]], most_states: int = MOST_STATES):
        self.most_states = most_states
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.made = {a + b: (k, a, b) for k, (a, b) in enumerate(merges)}
        self.prefixes = {t[:k] for t in self.made for k in range(1, len(t.removesuffix(END)))}
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """No states but the start: the others are compiled again as texts need them."""
        self.number: dict[State, int] = {}
        self.states: list[State] = []
        self.step: list[dict[str, tuple[int, int]]] = []
        self.last: list[dict[str, int]] = []
        self.start = self._state((("", "", 0),))

    def _state(self, s: State) -> int:
        if s not in self.number:
            self.number[s] = len(self.states)
            self.states.append(s)
            self.step.append({})
            self.last.append({})
        return self.number[s]

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols at one edge of a token, outermost first, each with the rank of the rule that consumes it."""
        out, until = [(token, len(self.rank))], token
        while until in self.made:
            rule = self.made[until]
            until = rule[1 + side]
            out.append((until, rule[0]))
        return out

    def _silent(self, left: str, right: str, but: int | None = None) -> bool:
        """No rule joins the two across their border while both edge symbols stand."""
        for a, a_gone in self._spine(left, 1):
            for b, b_gone in self._spine(right, 0):
                r = self.rank.get((a, b))
                # of equal rules the leftmost is applied first
                if r is not None and r < a_gone and r <= b_gone and r != but:
                    return False
        return True

    def _is_token(self, t: str) -> bool:
        """Do the rules turn the text of ``t`` into ``t`` itself?"""
        if t not in self.whole:
            rule = self.made.get(t)
            if rule is None:
                self.whole[t] = len(t.removesuffix(END)) == 1
            else:
                k, a, b = rule
                self.whole[t] = self._is_token(a) and self._is_token(b) and self._silent(a, b, but=k)
        return self.whole[t]

    def _follows(self, before: str, t: str) -> bool:
        if not before:
            return True
        key = (before, t)
        if key not in self.fits:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[key] = self._silent(before, t)
        return self.fits[key]

    def _token(self, s: int, symbol: str) -> tuple[str, int]:
        """The last token once ``symbol`` is read, and the count change."""
        for text, before, at in self.states[s]:
            t = text + symbol
            if (t in self.made or not text) and self._is_token(t) and self._follows(before, t):
                return t, at + 1
        raise AssertionError("no token ends here")

    def forward(self, s: int, c: str) -> tuple[int, int]:
        t, change = self._token(s, c)
        grown = tuple((text + c, before, at - change) for text, before, at in self.states[s] if text + c in self.prefixes)
        after = (*grown, ("", t, 0))
        if after not in self.number and len(self.states) >= self.most_states:
            self._forget()
            return self._state(after), change
        to = self._state(after)
        self.step[s][c] = to, change
        return to, change

    def count(self, word: str) -> int:
        """Tokens of a word of mapped symbols."""
        s, total = self.start, 0
        for c in word[:-1]:
            s, change = self.step[s].get(c) or self.forward(s, c)
            total += change
        c = word[-1]
        if c not in self.last[s]:
            self.last[s][c] = self._token(s, c + END)[1]
        return total + self.last[s][c]


# The map of a chunk, by what an open word p before it becomes:
# (head, None, tail): p + head is still open; (head, n, tail): p + head ends, n tokens in between, tail is open.
Map = tuple[bytes, int | None, bytes]


class Counter:
    def __init__(self, path: str, most_states: int = MOST_STATES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("only merge rules with word ends can be compiled")
        self.machine = Transducer([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], most_states)
        full = Tokenizer.from_file(path)
        self.normal, self.split = full.normalizer, full.pre_tokenizer
        specials = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(sorted(specials, key=len, reverse=True))) if specials else None
        self.plain = WORD_PATTERN in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.memo: dict[bytes, int] = {}

    def _parts(self, text: str) -> int:
        return sum(self.machine.count(p) for p, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text)))

    def _word(self, w: bytes) -> int:
        """Tokens of a run of bytes without ASCII white space, entered and left in the start state."""
        if self.plain and _ASCII(w) and b"<|" not in w:
            return sum(map(self.machine.count, _ASCII_WORDS(w.decode().lower())))
        text = w.decode("utf-8", "replace")
        if self.special is None:
            return self._parts(text)
        found = len(self.special.findall(text))
        return found + sum(self._parts(p) for p in self.special.split(text) if p)

    def word(self, w: bytes) -> int:
        n = self.memo.get(w)
        if n is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            n = self._word(w)
            if len(w) <= MEMO_BYTES:
                self.memo[w] = n
        return n

    def chunk(self, data: bytes) -> Map:
        words = data.split()
        if not words:
            return (b"", 0 if data else None, b"")
        if len(words) == 1 and len(words[0]) == len(data):
            return (data, None, b"")
        head = words.pop(0) if data[:1] not in SPACE else b""
        tail = words.pop() if words and data[-1:] not in SPACE else b""
        memo, word = self.memo, self.word
        return (head, sum([memo[w] if w in memo else word(w) for w in words]), tail)

    def compose(self, a: Map, b: Map) -> Map:
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        inner = a[2] + b[0]
        return (a[0], a[1] + b[1] + (self.word(inner) if inner else 0), b[2])

    def close(self, m: Map) -> int:
        """The count of a map entered at the start of a text and left at its end."""
        return (m[1] or 0) + sum(self.word(w) for w in (m[0], m[2]) if w)

    def count(self, text: bytes) -> int:
        if not text:
            return 0
        if len(text) <= CHUNK:
            return self.close(self.chunk(text))
        return self.close(self.last_of_scan([self.chunk(text[at:at + CHUNK]) for at in range(0, len(text), CHUNK)]))

    def last_of_scan(self, maps: list[Map]) -> Map:
        """The prefix scan's up-sweep, which leaves its last value: the map of
        the whole text.  (The maps in between would each hold their open word.)"""
        while len(maps) > 1:
            odd = maps[-1:] if len(maps) % 2 else []
            maps = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])] + odd
        return maps[0]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens.  Texts of any length are
    counted chunk by chunk.  Null ids and repeated rows give one row each;
    other columns are not read."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(tokenizer)
        texts = texts_of(b.column("text"))
        n = np.array([c.count(t) for t in texts], np.int64)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), i64([len(t) for t in texts]), i64(n), pa.array(n > limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"),
                                                           F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
