"""Language identification: averaged hashed subword embeddings under a linear
softmax, trained by stochastic gradient descent in numpy, with a calibrated
score and rejection.

A text is lower-cased, every byte that is not a letter becomes a space, and all
byte n-grams of the whole text are hashed into a table of embeddings.  The mean
embedding goes through a linear layer.  A fifth of the training sample is kept
out of the fit; pieces of many lengths of it set the temperature of the softmax
and the limits of rejection.

A softmax over the learned languages is sure of texts in any other, so rejection
asks another question: which part of the text's n-grams occurs in the training
texts at all?  This coverage must not fall below what the kept-out pieces of at
least the text's length show, less a margin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staywise.llm.common import count_rows, cut, map_batches, pick, prepare, texts_of

#: Label of texts without any letter.
UNDETERMINED = "und"
SIZES = (2, 3, 4)
#: Labels up to which their counts are broadcast.
MOST_LABELS = 10_000
#: Bytes hashed at once: bounds the arrays of a text of any length.
BLOCK = 1 << 20

# ASCII that is not a letter becomes a space; bytes of other letters stay.
_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def letters(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode().translate(_SPACED)


def has_letter(text: bytes) -> bool:
    s = text.decode("utf-8", "replace")
    return any(map(str.isalpha, s))


def ngrams(data: bytes, bits: int) -> np.ndarray:
    """Table rows of all n-grams of ``data`` (already folded), short ones padded."""
    b = np.frombuffer(b" " + data + b"   ", np.uint8).astype(np.uint32)
    out, h = [], b.copy()
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1:]
        if n in SIZES:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            out.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(out)


@dataclass
class Model:
    """``table``: each n-gram's contribution to the logits (embedding x
    weights); ``seen``: 1 if training texts hold it; ``limits``: the least
    coverage that is accepted, by the octave of the number of n-grams."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    seen: np.ndarray
    limits: np.ndarray
    bits: int

    def _means(self, text: bytes, table: np.ndarray) -> tuple[np.ndarray, int]:
        """Mean rows of ``table`` over all n-grams of the text, and how many these are."""
        data = letters(text)
        total, n = np.zeros(table.shape[1]), 0
        for at in range(0, max(1, len(data)), BLOCK):  # neighbouring blocks share 3 bytes
            idx = ngrams(data[max(0, at - 3 * (at > 0)):at + BLOCK], self.bits)
            total += np.bincount(idx, minlength=len(table)) @ table if len(idx) > 40_000 else \
                table[idx].sum(axis=0, dtype=np.float64)
            n += len(idx)
        return total / max(1, n), n

    def logits(self, text: bytes) -> np.ndarray:
        return self._means(text, self.table)[0] + self.bias

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])

    def rejects(self, text: bytes) -> bool:
        """No letter, or too many n-grams that no training text holds; a model
        that has learned no label has no limit."""
        if not has_letter(text):
            return True
        coverage, n = self._means(text, self.seen)
        return bool(self.labels) and bool(coverage[0] < self.limits[octave(n)])


def octave(n: int) -> int:
    """0 for up to 31 n-grams, 1 for up to 63 and so on, 9 for the longest."""
    return min(9, max(0, n.bit_length() - 5))


def pieces(data: bytes, rng: np.random.Generator) -> list[bytes]:
    """The folded text and runs of its words of about 12, 24, 48 ... bytes."""
    out, size = [data], 12
    while size < len(data):
        at = int(rng.integers(0, len(data) - size))
        words = data[at:at + size].split(b" ")
        out.append(b" ".join(words[1:-1] if len(words) > 3 else words))
        size *= 2
    return [x for x in out if x.strip()]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[bytes], langs: list[str], bits: int = 16, dim: int = 16, min_steps: int = 12_000,
          rate: float = 0.5, seed: int = 7, margin: float = 0.2) -> Model:
    """Plain SGD, one document a step, at least ``min_steps`` steps in whole
    epochs (five or more), learning rate falling linearly to zero.  ``margin``:
    where rejection begins on the way from the least covered kept-out piece (0)
    to n-grams at random (1)."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32), 1.0,
                     np.zeros((1 << bits, 1), np.float32), np.zeros(10), bits)
    y = np.array([labels.index(x) for x in langs])
    feats = []
    for t in texts:
        idx, cnt = np.unique(ngrams(letters(t), bits), return_counts=True)
        feats.append((idx, (cnt / cnt.sum()).astype(np.float32)))
    order = rng.permutation(len(y))
    held = order[:len(y) // 5]
    fit = order[len(y) // 5:]
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    w = np.zeros((dim, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    epochs = max(5, -(-min_steps // max(1, len(fit))))
    steps, total = 0, epochs * max(1, len(fit))
    for _ in range(epochs):
        for k in rng.permutation(fit):
            idx, share = feats[k]
            lr = rate * (1 - steps / total)
            mean = share @ emb[idx]
            g = softmax(mean @ w + bias)
            g[y[k]] -= 1
            back = w @ g
            w -= lr * np.outer(mean, g)
            bias -= lr * 0.1 * g
            # the mean spreads a step over thousands of rows, so rows move by it times the embedding size
            emb[idx] -= (lr * dim) * share[:, None] * back
            steps += 1
    table = (emb @ w).astype(np.float32)
    seen = np.zeros((1 << bits, 1), np.float32)
    for k in fit:
        seen[feats[k][0]] = 1
    rows = [(y[k], ngrams(x, bits)) for k in held for x in pieces(letters(texts[k]), rng)]
    if not rows:
        return Model(labels, table, bias, 1.0, seen, np.zeros(10), bits)
    z = np.array([table[idx].mean(axis=0, dtype=np.float64) for _, idx in rows]) + bias
    truth = np.array([label for label, _ in rows])
    temps = np.geomspace(0.002, 20, 93)
    loss = [-np.log(softmax(z / t)[np.arange(len(rows)), truth] + 1e-12).mean() for t in temps]
    least = np.ones(10)
    for _, idx in rows:  # whatever was predicted: these texts must stay
        at = octave(len(idx))
        least[:at + 1] = np.minimum(least[:at + 1], seen[idx, 0].mean(dtype=np.float64))
    longest = max(octave(len(idx)) for _, idx in rows)
    least[longest:] = least[longest]
    return Model(labels, table, bias, float(temps[int(np.argmin(loss))]), seen, least - margin * (least - seen.mean()), bits)


def labelled_sample(docs: DataFrame, per_label: int = 600, max_chars: int = 8000, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The training sample: at most ``per_label`` documents of each label, those
    of least id hash, among the ones of 20 to ``max_chars`` characters whose
    hash is below a limit that lets about twice as many through.  Both bounds
    hold for the sample only; predictions read whole texts."""
    d = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    d = d.where("lang is not null and text is not null and doc_id is not null")
    d = d.where(F.length("text").between(20, max_chars))
    # counted first, so that only about the sample's own texts are moved and ranked
    n = d.groupBy(F.col("lang").alias("l_")).agg(F.count(F.lit(1)).alias("n_"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    n = cut(n)
    n = F.broadcast(n) if count_rows(n) <= MOST_LABELS else n
    few = d.join(n, F.col("lang") == F.col("l_")).where(place * F.col("n_") < 2 * per_label + 20)
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    ranked = few.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= per_label)
    return ranked.select(F.col("text").cast("binary").alias("text"), "lang")


def fit(docs: DataFrame, per_label: int = 600, **cols: str) -> Model:
    """Fit on ``labelled_sample``; deterministic for the same rows."""
    rows = sorted((r["lang"], bytes(r["text"])) for r in labelled_sample(docs, per_label, **cols).collect())
    return train([t for _, t in rows], [lang for lang, _ in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (calibrated, 0 to 1).

    Null, empty and letterless texts give ``und`` with score 0, and so do all
    texts if the model was fitted without any labelled text.
    Whole texts are read, in blocks.  Repeated rows and null ids give one row
    each; no other column is read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2**bits x labels floats, fixed by the parameters

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        got = [m.predict(t) for t in texts_of(b.column("text"))]
        lang, score = [x for x, _ in got], [s for _, s in got]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"),
                                                           F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose whole text the model does not reject; null
    and letterless texts go.  Nothing is shuffled."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and not shared.value.rejects(t.encode())).astype(bool)

    return docs.where(keeps(F.col(f"`{text_col}`")))
