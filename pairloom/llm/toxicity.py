"""Severity of toxicity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) is the logistic of a threshold less the document's score; thresholds are ordered, and one weight vector
serves all of them. Features are 1 + ln(count) of selected words and word beginnings. The model is fitted by full-batch Adam on a
bounded sample of graded documents (``TRAIN_ROWS``, those whose id hashes lowest); every document is scored, on its
whole text.

Where labels are only 0 or 1, ``severity_grades`` grades the toxic ones by thirds of out-of-fold scores. Words are
counted, near copies dropped and features chosen in Spark; the driver gets the chosen words' counts alone.

Nulls and empty texts get the severity of a document without features. Labels that are null, or whose document is
missing, are not learned from; with fewer than two grades to learn from, every severity is 0. Repeated rows stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.textvec import FOLDED, NON_LETTERS, Words, chunks, map_batches, mix, runs
from pairloom.storage import materialise

#: Graded documents that a model is fitted on, at most, and words it may use.
TRAIN_ROWS, MAX_WORDS, LEAST_DOCS = 6000, 400, 8
#: Besides whole words, features are their first so many bytes: stems of languages that inflect.
PREFIXES = (4, 5, 6)
#: Half the G statistic that a word needs: one word in a million reaches it by chance.
LEAST_G = 12.0
#: Buckets of the sketch that finds near copies in the sample, and keys made of them; folds of the grading.
BUCKETS, KEYS, FOLDS = 64, 8, 3
_U = np.uint64


@dataclass(frozen=True)
class Ordinal:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than there are grades

    def cumulative(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - scores[:, None]))

    def severity(self, scores: np.ndarray) -> np.ndarray:
        return self.cumulative(scores).sum(1)


def counts(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, word hash or place in wanted, count)`` of each distinct word of each text."""
    words = Words(data, offs, breaks=NON_LETTERS)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(words.bounds))
    texts, keys = [text], [words.hash]
    lower = FOLDED[data]
    for p in PREFIXES:
        long = np.flatnonzero(words.end - words.start > p)
        texts.append(text[long])
        keys.append(mix(runs(lower, words.start[long], words.start[long] + p, "byte"), p))
    text, key = np.concatenate(texts), np.concatenate(keys)
    if wanted is not None:
        if not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        hit = wanted[at] == key
        both, n = np.unique(text[hit] * len(wanted) + at[hit], return_counts=True)
        return both // len(wanted), both % len(wanted), n
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])] if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return text[first], key[first], np.diff(np.r_[first, len(key)])


@dataclass(frozen=True)
class Sample:
    """Sparse counts of graded documents: entry i says that document ``row[i]`` has ``words[col[i]]`` ``count[i]`` times."""

    labels: np.ndarray
    words: np.ndarray  # sorted hashes of the chosen features
    row: np.ndarray
    col: np.ndarray
    count: np.ndarray


def _count_batches(batches):
    for batch in batches:
        for at, to, data, offs in chunks(batch.column(2)):
            text, word, count = counts(data, offs)
            bounds = np.searchsorted(text, np.arange(to - at + 1))
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, t))
            digest = [int(np.add.reduce(mix(word[s:e] * count[s:e].astype(_U), 9)).astype(np.int64)) for s, e in zip(bounds[:-1], bounds[1:])]
            keys = [sketch(word[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(digest, pa.int64()), pa.array(keys, pa.list_(pa.int64())), lists(word.view(np.int64), pa.int64()), lists(count.astype(np.int32), pa.int32())],
                ["doc_id", "label", "digest", "keys", "words", "counts"],
            )


def sketch(words: np.ndarray) -> np.ndarray:
    """Keys of a set of words, each of the least hashes in some of its buckets; near copies agree in one of them."""
    h = mix(words, 21)
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, _U)
    np.minimum.at(least, (h >> _U(58)).astype(np.int64), h)
    some = least.reshape(KEYS, -1)
    odd = np.arange(1, 2 * some.shape[1], 2).astype(_U)
    return mix((mix(some, 5) * odd).sum(1, dtype=_U)).view(np.int64)


def gather(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, label, words, counts`` of the ``rows`` labels whose ids hash lowest; of equal texts and near copies one.

    Near copies would make a group's own words look telling. A document is one if it shares six tenths of its words with
    the smallest id of a group that has a key of the sketch in common.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    schema = "doc_id long, label int, digest long, keys array<long>, words array<long>, counts array<int>"
    # At most ``rows`` labels are broadcast.
    found = map_batches(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), _count_batches, schema)
    one = found.groupBy("digest").agg(F.min(F.struct("doc_id", "label", "keys", "words", "counts")).alias("r")).select("r.*")
    one = materialise(one, "sample")
    keys = one.select("doc_id", F.posexplode("keys").alias("i", "key"))
    least = keys.groupBy("i", "key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = keys.join(least, ["i", "key"]).where("doc_id <> first").select("doc_id", "first").distinct()
    own, other = one.select("doc_id", "words"), one.select(F.col("doc_id").alias("first"), F.col("words").alias("others"))
    common = F.size(F.array_intersect("words", "others"))
    near = pairs.join(own, "doc_id").join(other, "first").where(10 * common >= 6 * (F.size("words") + F.size("others") - common))
    return one.join(near.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "label", "words", "counts")


def telling_words(rows: DataFrame, most: int = MAX_WORDS, least: int = LEAST_DOCS) -> np.ndarray:
    """The features, sorted, whose presence raises the odds of a label above 0 most surely, by the G-test.

    Words are counted by label in Spark; at most ``most`` come to the driver.
    """
    total, good = rows.agg(F.count("*"), F.count_if(F.col("label") > 0)).first()
    if not good or good == total:
        return np.zeros(0, _U)
    n, k, share = F.col("n").cast("double"), F.col("k").cast("double"), good / total
    part = lambda seen, p: F.when(seen > 0, seen * F.ln(seen / (n * p))).otherwise(0.0)
    seen = rows.select((F.col("label") > 0).alias("toxic"), F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_if("toxic").alias("k"))
    g = F.round(part(k, share) + part(n - k, 1 - share), 6)
    best = seen.where((k > n * share) & (n >= least)).select("word", g.alias("g")).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "word").limit(most)
    return np.sort(np.array([r.word for r in best.collect()], np.int64).view(_U))


def sparse(rows: DataFrame, words: np.ndarray) -> Sample:
    """Home come labels and the counts of the chosen words alone: ``TRAIN_ROWS`` rows of ``MAX_WORDS`` entries at most."""
    chosen = [int(w) for w in words.view(np.int64)]
    cells = F.filter(F.arrays_zip("words", "counts"), lambda x: x["words"].isin(chosen)) if chosen else F.array().cast("array<struct<words:bigint,counts:int>>")
    table = rows.select("doc_id", "label", cells["words"].alias("w"), cells["counts"].alias("n")).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    w, n = (table.column(c).combine_chunks() for c in ("w", "n"))
    flat = w.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
    row = np.repeat(np.arange(len(w)), w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) if len(w) else np.zeros(0, np.int64)
    return Sample(table.column("label").to_numpy().astype(np.int64), words, row, np.searchsorted(words, flat), n.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def severity_grades(sample: Sample, folds: int = FOLDS) -> np.ndarray:
    """0 for label 0; else 1 to 3 by thirds of the score that a model fitted without the document's fold gives it.

    Labels justify the first threshold alone; the others order toxic documents by how sure others' labels make us.
    """
    y = (sample.labels > 0).astype(np.int64)
    fold, out = np.arange(len(y)) % folds, y.copy()
    if y.sum() < 3 * folds or y.all():
        return out
    x = 1 + np.log(sample.count)
    score = np.zeros(len(y))
    for k in range(folds):
        mine = np.flatnonzero(fold != k)
        place = np.full(len(y), -1)
        place[mine] = np.arange(len(mine))
        hit = place[sample.row] >= 0
        model = fit(Sample(y[mine], sample.words, place[sample.row[hit]], sample.col[hit], sample.count[hit]), y[mine], steps=200)
        weights = model.weights if len(model.weights) else np.zeros(len(sample.words))
        score[fold == k] = np.bincount(sample.row, weights=x * weights[sample.col], minlength=len(y))[fold == k] if len(sample.row) else 0
    toxic = y > 0
    out[toxic] += np.searchsorted(np.quantile(score[toxic], [1 / 3, 2 / 3]), score[toxic], "left")
    return out


def fit(sample: Sample, grades: np.ndarray, penalty: float = 1e-6, steps: int = 600) -> Ordinal:
    levels = int(grades.max(initial=0))
    if len(grades) == 0 or levels == 0 or (grades > 0).all():
        return Ordinal(np.zeros(0, _U), np.zeros(0), np.full(max(levels, 1), np.inf))
    row, col, x = sample.row, sample.col, 1 + np.log(sample.count)
    n, k = len(grades), levels
    above = np.array([(grades >= j).mean() for j in range(1, k + 1)])
    first = np.log((1 - above[0]) / above[0])
    # theta_1, then logarithms of the gaps, keep the thresholds in order.
    params = np.concatenate([np.zeros(len(sample.words)), [first], np.full(k - 1, np.log(0.5))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    f = len(sample.words)
    for t in range(1, steps + 1):
        w, gaps = params[:f], np.exp(params[f + 1 :])
        theta = params[f] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(row, weights=x * w[col], minlength=n)
        edge = np.column_stack([np.full(n, -40.0), theta[None, :] - s[:, None], np.full(n, 40.0)])
        cdf = 1 / (1 + np.exp(-np.clip(edge, -40, 40)))
        i = np.arange(n)
        lo, hi = cdf[i, grades], cdf[i, grades + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_theta = np.array([-(d_hi[grades == j].sum() - d_lo[grades == j + 1].sum()) for j in range(k)]) / n
        grad = np.empty_like(params)
        grad[:f] = np.bincount(col, weights=x * (d_hi - d_lo)[row], minlength=f) / n + penalty * w
        grad[f] = g_theta.sum()
        for j in range(k - 1):
            grad[f + 1 + j] = g_theta[j + 1 :].sum() * gaps[j]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        # A telling word never lowers the severity.
        np.maximum(params[:f], 0, out=params[:f])
    return Ordinal(sample.words, params[:f], params[f] + np.concatenate([[0.0], np.cumsum(np.exp(params[f + 1 :]))]))


def score(docs: DataFrame, model: Ordinal, threshold: float = 0.5) -> DataFrame:
    """``doc_id, severity, p_toxic, grade, toxic`` for each row: severity is the expected grade, and a document is toxic
    if P(grade >= 1) reaches ``threshold``; grade is the number of thresholds more likely passed than not."""

    def run(batches):
        for batch in batches:
            for at, to, data, offs in chunks(batch.column(1)):
                text, word, n = counts(data, offs, model.words)
                s = np.bincount(text, weights=(1 + np.log(n)) * model.weights[word], minlength=to - at) if len(text) else np.zeros(to - at)
                p = model.cumulative(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(1), pa.int64()), pa.array(p[:, 0] >= threshold)],
                    ["doc_id", "severity", "p_toxic", "grade", "toxic"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, "doc_id long, severity double, p_toxic double, grade long, toxic boolean")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, graded: bool = False) -> Ordinal:
    """``graded``: the label is a severity from 0 already."""
    found = materialise(gather(docs, labels, label, rows), "graded")
    sample = sparse(found, telling_words(found))
    return fit(sample, sample.labels if graded else severity_grades(sample))
