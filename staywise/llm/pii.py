"""Personal data: regular expressions propose spans, checksums confirm them,
nearby context words adjust the score.

``BASE`` kinds are fixed by pattern and test alone and are always reported.
Scored kinds add spans that the fixed patterns miss (a phone or card number
that runs into a neighbouring number, bank accounts, social security numbers).
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import map_batches, pick, prepare

Span = tuple[int, int, str]

#: Order of the kinds at one start.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# possessive, and only from the start of a run of digits: linear in the text
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_CARD_ALONE = re.compile(r"(?<![0-9])[3-6][0-9]{12,18}(?![0-9])|(?<![0-9])[3-6][0-9]{3}(?:[ -][0-9]{4}){3}(?![0-9])")
_PHONE_ALONE = re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Words near a span that raise its score.
CONTEXT = {
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax"),
}
#: Score of a bare pattern, what a valid checksum and a context word add, and the score to report at.
PATTERN = {"card": 0.3, "phone": 0.4, "iban": 0.3, "ssn": 0.4}
CHECKSUM, NEARBY, REPORT = 0.4, 0.3, 0.6
WINDOW = 50


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @ outwards, so that long runs of
    letters cost one pass."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _part_ok(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 4 and int(p or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The fixed kinds: leftmost, not overlapping within a kind; a match that
    fails its test is dropped and not tried again in another form."""
    out = list(_emails(text)) if "@" in text else []
    if _HAS_DIGIT(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_part_ok, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_HAS_DIGIT = re.compile("[0-9]").search


def score(kind: str, text: str, start: int, end: int) -> float:
    s = PATTERN[kind]
    found = text[start:end]
    if kind == "card":
        s += CHECKSUM if luhn(_digits(found)) else -CHECKSUM
    elif kind == "iban":
        s += CHECKSUM if mod97(found) else -CHECKSUM
    elif kind == "phone" and found.startswith("+"):
        s += NEARBY
    around = set(re.findall(r"[a-z]+", (text[max(0, start - WINDOW):start] + " " + text[end:end + WINDOW]).lower()))
    return s + NEARBY * (not around.isdisjoint(CONTEXT[kind]))


def scored_spans(text: str, taken: list[Span]) -> list[Span]:
    """Spans of the scored kinds that reach ``REPORT`` and lie in no reported span of their kind."""
    if not _HAS_DIGIT(text):
        return []
    out = []
    for kind, pattern in (("card", _CARD_ALONE), ("phone", _PHONE_ALONE), ("iban", _IBAN), ("ssn", _SSN)):
        own = [(a, b) for a, b, k in taken if k == kind]
        for m in pattern.finditer(text):
            a, b = m.span()
            if score(kind, text, a, b) >= REPORT and not any(x < b and a < y for x, y in _near(own, a, b)):
                out.append((a, b, kind))
    return out


def _near(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    from bisect import bisect_left

    k = bisect_left(spans, (a, a))
    return spans[max(0, k - 1):bisect_left(spans, (b, b)) + 1]


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(fixed spans, all spans), by start, then kind."""
    base = base_spans(text)
    both = base + scored_spans(text, base)
    return base, sorted(both, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def mask(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        a, b, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id; n_<kind> of the fixed kinds; base_sha256
    (of the joined fixed spans); spans (all, joined).  Null texts count as
    empty: no spans, the digest of the empty string.  Null ids and repeated
    rows give one row each; other columns are not read."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = {k: [] for k in BASE}, [], []
        for text in b.column("text").to_pylist():
            base, all_ = find(text or "")
            for k in BASE:
                counts[k].append(sum(s[2] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(all_))
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE),
             pa.array(digests, pa.string()), pa.array(spans, pa.string())],
            ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_batches(rows, run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with every reported span of ``text_col`` masked; null stays null."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mask(t, find(t)[1]))

    prepare(docs.sparkSession)
    return docs.withColumn(text_col, hide(F.col(f"`{text_col}`")))
