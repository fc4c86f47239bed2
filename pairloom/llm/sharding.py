"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, from two hashes of its name. Shards take turns,
each claiming the next free slot of its permutation, until the table is full; so loads differ by one slot at most, and
when a shard leaves, few slots other than its own change hands. A key is placed by one hash and one lookup. The table is
broadcast: its size is the parameter ``slots``, whatever the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: A prime far above 100 times the number of shards keeps loads even.
SLOTS = 65537


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The number of the shard that holds each slot. ``slots`` must be prime and at least the number of shards."""
    if not shards or len(set(shards)) < len(shards) or slots < len(shards):
        raise ValueError("shards must be distinct, at least one, and at most as many as slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    start = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    table = np.full(slots, -1, np.int32)
    taken = [0] * len(shards)
    left = slots
    while left:
        for i in range(len(shards)):
            while True:
                slot = (start[i] + taken[i] * step[i]) % slots
                taken[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """From the first 60 bits of the key's SHA-256, so that any engine can place a key."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 15), 16, 10).cast("long") % slots


def assign_shards(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``doc_id, slot, shard`` for each row, by ``key``. Rows with a null key go where the empty string goes."""
    spark = docs.sparkSession
    table = fill(shards, slots)
    rows = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "slot long, shard string")
    placed = docs.select(F.col("doc_id"), slot_of(F.coalesce(F.col(key).cast("string"), F.lit("")), slots).alias("slot"))
    return placed.join(F.broadcast(rows), "slot").select("doc_id", "slot", "shard")
