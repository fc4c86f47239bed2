"""Leaving out most rows that a join would drop, before their texts are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.textvec import map_batches, mix

#: 64-bit words of the filter: 8 MB, whatever the data. More ids make it let more through.
WORDS = 1 << 20
_SEEDS = (101, 202, 303)


def _places(ids: np.ndarray) -> np.ndarray:
    """The bits of each id, a row for each hash."""
    return np.array([mix(ids.astype(np.uint64), s) & np.uint64(WORDS * 64 - 1) for s in _SEEDS])


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """Of the first column of ``ids``. At most ``WORDS`` numbers come to the driver."""

    def bits(batches):
        for batch in batches:
            at = _places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    rows = ids.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(WORDS, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def among(ids: DataFrame):
    """A function for tasks, which leaves of a batch the rows whose first column is among ``ids``, and a few others."""
    filled = ids.sparkSession.sparkContext.broadcast(bloom_filter(ids))

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = _places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        hit = (filled.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        return batch.filter(pa.array(hit.all(0)))

    return some


def maybe_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``docs(doc_id, ...)`` whose id is among ``ids``, and a few others."""
    some = among(ids)
    return map_batches(docs, lambda batches: map(some, batches), docs.schema)
