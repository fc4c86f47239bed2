"""Repeated passages by sparse suffix arrays.

Of all suffixes of a text, only those are retained that start at a minimiser: the word whose ``GRAM``-word hash is least
in some window of ``least - GRAM + 1`` places. Every run of ``least`` words holds one, at the same place in every copy.
No suffix order is made: retained suffixes are grouped by a 64-bit hash of their first ``GRAM`` words, and those alone in
their group are done with. The rest are grouped by a hash of all the words that a repeated run around the minimiser can
reach, left and right, and members of one context extend fully. Only equality matters here, for which groups by hash
give what equal neighbours in the order would, up to collisions, without sorting long keys. Where contexts differ, the match is extended to the left and right word by word: each run of ``least`` words that
has this minimiser is looked up among those of the other contexts of the group. So the result is exact: a word is covered
if and only if it lies in a run of ``least`` words that occurs elsewhere in the corpus, in another text or in its own.

A passage that a third of all texts share folds into one context before anything is compared; no pairs are formed. Null,
empty and shorter texts have no spans. Rows that share an id count as one text, the one that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.bloom import maybe_in
from pairloom.llm.textvec import Words, chunks, map_batches, runs
from pairloom.storage import materialise

#: Words of a repeated passage, at least; words by which suffixes are sorted first.
LEAST, GRAM = 50, 8
_U = np.uint64


class Retained:
    """The suffixes of a chunk that are retained, with the runs of ``least`` words that each of them stands for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, least: int):
        words = Words(data, offs)
        self.words = words
        n = len(words.hash)
        span = least - GRAM + 1
        self.at = self.lo = self.hi = self.text = np.zeros(0, np.int64)
        if n < least:
            return
        grams = words.grams(GRAM)
        # The least hash wins, of equal ones the leftmost: high bits of the hash, then the place.
        best = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)
        width = 1
        while 2 * width <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < span:
            best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
        run = np.arange(n - least + 1)
        text = np.searchsorted(words.bounds, run, "right") - 1
        whole = run + least <= words.bounds[text + 1]
        run, text, place = run[whole], text[whole], (best[run[whole]] & _U(0xFFFFFFFF)).astype(np.int64)
        if not len(run):
            return
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
        last = np.r_[first[1:], len(run)] - 1
        self.at, self.text, self.lo, self.hi = place[first], text[first], run[first], run[last]

    def keys(self) -> np.ndarray:
        """The hash of the first ``GRAM`` words."""
        return runs(self.words.hash, self.at, self.at + GRAM, "word")

    def contexts(self, least: int) -> np.ndarray:
        """The hash of all words of the runs, and of the minimiser's place among them."""
        return runs(self.words.hash, self.lo, self.hi + least, "word") ^ ((self.at - self.lo) * 1_000_003 + (self.hi - self.lo)).astype(_U) * _U(0x9E3779B97F4A7C15)


def _suffixes(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, at, lo, hi, key, context``: places are words of the text."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offs in chunks(batch.column(1)):
                kept = Retained(data, offs, least)
                base = kept.words.bounds[kept.text]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(kept.text)), *(pa.array((x - base).astype(np.int32)) for x in (kept.at, kept.lo, kept.hi)), pa.array(kept.keys().view(np.int64)), pa.array(kept.contexts(least).view(np.int64))],
                    ["doc_id", "at", "lo", "hi", "key", "context"],
                )

    return map_batches(docs, run, "doc_id long, at int, lo int, hi int, key long, context long")


def _windows(docs: DataFrame, least: int) -> DataFrame:
    """``context, lo, hashes`` for each place in ``places`` of a text: the hashes of the runs it stands for, in order."""

    def run(batches):
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1)):
                words = Words(data, offs)
                wanted = batch.column(2).slice(a, b - a).to_pylist()
                rows = [(p["context"], p["at"] + s, p["lo"] + s, p["hi"] + s) for s, ps in zip(words.bounds[:-1].tolist(), wanted) for p in ps]
                if not rows:
                    continue
                context, _, lo, hi = (np.array(x, np.int64) for x in zip(*rows))
                size = hi - lo + 1
                ends = np.cumsum(size)
                start = np.repeat(lo - (ends - size), size) + np.arange(ends[-1])
                found = runs(words.hash, start, start + least, "word").view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(context), pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(found))], ["context", "hashes"])

    return map_batches(docs, run, "context long, hashes array<long>")


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, start_word, end_word, n_words`` of each maximal stretch of words covered by runs of ``least`` words that
    occur twice or more; words are runs of other than white space, A-Z as a-z, counted from 0, ends exclusive."""
    if least < GRAM:
        raise ValueError(f"at least {GRAM} words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    kept = materialise(_suffixes(docs, least), "suffixes")
    # One row for each context: its number, and the first place it was seen at.
    contexts = kept.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at", "lo", "hi")).alias("first"))
    groups = contexts.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    contexts = materialise(contexts.join(groups, "key"), "contexts")

    # Groups of more than one context: extend, run by run.
    open_ = contexts.where("kinds > 1")
    places = open_.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("context", "first.at", "first.lo", "first.hi")).alias("places"))
    texts = docs.groupBy("doc_id").agg(F.min("text").alias("text")) if _repeats(kept) else docs
    texts = maybe_in(texts, places.select("doc_id"))
    found = _windows(texts.join(places, "doc_id").select("doc_id", "text", "places"), least)
    found = found.join(open_.select("key", "context", "n"), "context").select("key", "context", "n", F.posexplode("hashes").alias("i", "h"))
    found = materialise(found, "runs")
    twice = found.groupBy("key", "h").agg(F.sum("n").alias("total")).where("total > 1")
    shared = found.join(twice.select("key", "h"), ["key", "h"], "left_semi").groupBy("context").agg(F.array_sort(F.collect_set("i")).alias("runs"))

    alone = contexts.where("kinds = 1").select("context", F.lit(None).cast("array<int>").alias("runs"))
    hits = kept.join(alone.union(shared.select("context", "runs")), "context")
    # Runs lo + i that are repeated; all of them where every copy has the same context.
    spans = F.when(F.col("runs").isNull(), F.array(F.struct(F.col("lo").alias("s"), F.col("hi").alias("e")))).otherwise(_stretches(F.col("runs"), F.col("lo")))
    rows = hits.select("doc_id", F.explode(spans).alias("x")).select("doc_id", F.col("x.s").alias("s"), (F.col("x.e") + least).alias("e"))
    merged = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    joined = F.aggregate(
        "spans",
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["s"].alias("s"), F.greatest(F.get(acc, F.size(acc) - 1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x))),
    )
    out = merged.select("doc_id", F.explode(joined).alias("x"))
    return out.select("doc_id", F.col("x.s").cast("long").alias("start_word"), F.col("x.e").cast("long").alias("end_word"), (F.col("x.e") - F.col("x.s")).cast("long").alias("n_words"))


def _stretches(runs_at, lo):
    """Consecutive numbers of a sorted array as structs of first and last, moved by ``lo``."""
    return F.aggregate(
        runs_at,
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, i: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["e"] + 1 == i + lo), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["s"].alias("s"), (i + lo).alias("e"))))).otherwise(
            F.concat(acc, F.array(F.struct((i + lo).alias("s"), (i + lo).alias("e"))))
        ),
    )


def _repeats(kept: DataFrame) -> bool:
    """Whether some id has two rows."""
    return not kept.groupBy("doc_id", "at").count().where("count > 1").isEmpty()
