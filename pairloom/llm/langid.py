"""Language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are 1- to 3-grams of lower-cased letters (everything else is a blank), hashed into ``BUCKETS``. A value is the
n-gram's share of the text times its inverse document frequency, which counts all training documents. Weights come from
follow-the-regularised-leader with elastic-net penalties, on a bounded sample of the training documents (``TRAIN_ROWS``
of each language, so that rare languages are learned too); a temperature fitted on a fifth of each language's part
calibrates the scores. Every document is predicted on its whole text.

A text that is null or has no letter is ``und`` with score 0. Without labelled documents every prediction is ``und``.
Repeated rows stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.llm.textvec import chunks
from pairloom.storage import materialise

BUCKETS = 1 << 16
TRAIN_ROWS, EPOCHS = 800, 3
#: FTRL: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4
#: Shares are small numbers.
SCALE = 50.0
UNKNOWN = "und"
_POINTS = 0x20000
_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], _U)
_lower: list[np.ndarray] = []


def _table() -> np.ndarray:
    """The lower-case letter for each character; a blank for all that are no letters."""
    if not _lower:
        out = np.full(_POINTS + 1, 0x20, np.uint32)
        for p in range(_POINTS):
            c = chr(p)
            if c.isalpha():
                low = c.lower()
                out[p] = ord(low) if len(low) == 1 else p
        out[_POINTS] = _POINTS  # ideographs beyond, as one letter
        _lower.append(out)
    return _lower[0]


def letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters of a chunk, blanks for what is no letter, and the offsets of its texts in characters."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    wide = points >= _POINTS
    if wide.any():
        points = np.where(wide, np.where((points >= 0x20000) & (points < 0x32400), _POINTS, 0x20), points)
    return _table()[points], before[offs]


def grams(chars: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For n = 1, 2, 3 the bucket at each character; ``BUCKETS`` where no n-gram starts within the text."""
    c = chars.astype(_U) + _U(1)
    out, acc = [], np.zeros(len(c), _U)
    for n in range(3):
        shifted = np.zeros(len(c), _U)
        if n < len(c):
            shifted[: len(c) - n] = c[n:] * _MULT[n]
        acc = acc + shifted
        h = (acc ^ (acc >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        bucket = (h >> _U(48)).astype(np.int64)
        for back in range(n):
            last = offs[1:] - 1 - back
            bucket[last[last >= offs[:-1]]] = BUCKETS
        out.append(bucket)
    return out


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@dataclass(frozen=True)
class Model:
    langs: list[str]
    #: Weights times inverse document frequency, a row for each language; the last bucket is 0.
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, chars: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probabilities, a row for each text."""
        size = np.diff(offs)
        z = np.zeros((len(size), len(self.langs)))
        some = np.flatnonzero(size > 0)
        if len(some):
            found = grams(chars, offs)
            for i, row in enumerate(self.table):
                for bucket in found:
                    z[some, i] += np.add.reduceat(row[bucket], offs[:-1][some], dtype=np.float64)
        z = (z * SCALE / np.maximum(size, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)


def _frequencies(batches):
    """Document frequency of each bucket in one task."""
    df = np.zeros(BUCKETS + 1, np.int64)
    n = 0
    for batch in batches:
        for _, _, data, offs in chunks(batch.column(0)):
            chars, at = letters(data, offs)
            found = grams(chars, at)
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                n += 1
                own = np.concatenate([b[s:e] for b in found])
                if len(own) < 4000:
                    df[np.unique(own)] += 1
                else:
                    df += np.bincount(own, minlength=BUCKETS + 1) > 0
    df[BUCKETS] = n
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["bucket", "df"])


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Over all of ``docs(text)``; the last entry is the number of documents."""
    parts = docs.select("text").mapInArrow(_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    found = parts.toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("df").to_numpy()
    return out


def _sparse(batches):
    for batch in batches:
        for at, to, data, offs in chunks(batch.column(2)):
            chars, bounds = letters(data, offs)
            found = grams(chars, bounds)
            keys, values = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                k, n = np.unique(np.concatenate([b[s:e] for b in found]), return_counts=True)
                keep = k < BUCKETS
                keys.append(k[keep].astype(np.int32).tobytes())
                values.append((n[keep] / max(e - s, 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "lang", "keys", "shares"])


def ftrl(samples: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x BUCKETS) and biases from ``(class, buckets, values)``, one at a time."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for i in order.permutation(len(samples)):
            y, at, x = samples[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS].T, w[BUCKETS]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one of a fixed grid with the least log loss."""

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    return min((2.0 ** (i / 4) for i in range(-12, 17)), key=loss) if len(y) else 1.0


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """From the ``docs(doc_id, text, lang)`` that aren't held out and have a language."""
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    df = document_frequencies(known)
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    # Spark keeps the first rows of each language in each task before it deals them out.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = materialise(known.select("doc_id", "lang").withColumn("place", place).where(F.col("place") <= rows).select("doc_id").distinct(), "chosen")
    # At most ``rows`` ids of each language are broadcast.
    table = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text").mapInArrow(_sparse, "doc_id long, lang string, keys binary, shares binary").toArrow().sort_by("doc_id")
    langs = sorted(set(table.column("lang").to_pylist()))
    samples, fifth = [], []
    nth: dict[str, int] = {}
    for lang, k, v in zip(*(table.column(c).to_pylist() for c in ("lang", "keys", "shares"))):
        nth[lang] = nth.get(lang, -1) + 1
        fifth.append(nth[lang] % 5 == 4)
        k = np.frombuffer(k, np.int32).astype(np.int64)
        samples.append((langs.index(lang), k, np.frombuffer(v, np.float32) * idf[k] * SCALE))
    if not samples:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), np.zeros(0), 1.0)
    w, bias = ftrl([s for s, out in zip(samples, fifth) if not out], len(langs))
    rest = [s for s, out in zip(samples, fifth) if out]
    logits = np.array([w[:, k] @ x + bias for _, k, x in rest]).reshape(-1, len(langs))
    t = temperature(logits, np.array([y for y, _, _ in rest]))
    return Model(langs, np.column_stack([w * idf, np.zeros(len(langs))]).astype(np.float32), bias, t)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs(doc_id, text)``."""
    names = np.array([*model.langs, UNKNOWN], dtype=object)

    def run(batches):
        for batch in batches:
            for at, to, data, offs in chunks(batch.column(2)):
                chars, bounds = letters(data, offs)
                solid = np.zeros(len(chars) + 1, np.int64)
                np.cumsum(chars != 0x20, out=solid[1:])
                some = np.diff(solid[bounds]) > 0
                best, p = np.full(to - at, len(names) - 1), np.zeros(to - at)
                if model.langs:
                    scores = model.scores(chars, bounds)
                    best, p = np.where(some, scores.argmax(1), best), np.where(some, scores.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(names[best].tolist(), pa.string()), pa.array(p)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
