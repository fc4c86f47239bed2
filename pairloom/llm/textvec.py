"""Words and hashes of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Words are maximal runs of bytes other than ``\\x20\\x09-\\x0D``; none of those occurs inside a multi-byte character, so
the byte view and the character view agree.

A word's hash is the sum of random table entries, one for each byte and its place in a block of ``BLOCK`` bytes; blocks
are mixed and summed with a random odd factor each. Two words of equal length differ in a sum of independent random
numbers, so no words are built that collide, as they are for polynomials modulo 2^64. ``runs`` is such a polynomial: over
mixed word hashes and runs of some hundred words at most, where the factors that all powers of two share leave 38 bits or
more even for sequences made to collide (Thue-Morse), and over bytes for short prefixes and where bytes are compared too.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts are handled together up to so many bytes; one longer text is handled alone.
CHUNK_BYTES = 1 << 17
#: Rows that go to a Python worker at once; they are in memory as many times as there are task slots.
BATCH_ROWS = 300

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters.
NON_LETTERS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_U = np.uint64
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
#: The coefficient of each byte, with A-Z as a-z.
FOLDED = _LOWER
#: Bytes of a word that the tables tell apart by place.
BLOCK = 64
_PLACED = _rng.integers(-(2**63), 2**63 - 1, BLOCK * 256, dtype=np.int64).view(_U)
_PLACED_LOWER = _PLACED.reshape(BLOCK, 256).copy()
_PLACED_LOWER[:, 65:91] = _PLACED_LOWER[:, 97:123]
_PLACED_LOWER = _PLACED_LOWER.ravel()
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F}
_powers: dict[tuple[str, bool], np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + _U(seed)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, inverse: bool, n: int) -> np.ndarray:
    have = _powers.get((kind, inverse))
    if have is None or len(have) < n:
        base = _BASES[kind]
        if inverse:
            base = pow(base, -1, 1 << 64)
        out = np.full(max(n, CHUNK_BYTES + 2), base, _U)
        out[0] = 1
        have = _powers[kind, inverse] = np.multiply.accumulate(out)
    return have[:n]


def runs(values: np.ndarray, start: np.ndarray, end: np.ndarray, kind: str) -> np.ndarray:
    """The hash of ``values[start[i]:end[i]]`` for each i."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _power(kind, False, len(values)), out=total[1:])
    return mix((total[end] - total[start]) * _power(kind, True, len(values) + 1)[start])


def word_hashes(letters: np.ndarray, size: np.ndarray, lower: bool) -> np.ndarray:
    """The hash of each word, from the bytes of all words one after another and their sizes, which are positive."""
    if not len(size):
        return np.zeros(0, _U)
    end = np.cumsum(size)
    place = np.arange(len(letters)) - np.repeat(end - size, size)
    values = (_PLACED_LOWER if lower else _PLACED)[(place & (BLOCK - 1)) << 8 | letters]
    blocks = (size + BLOCK - 1) // BLOCK
    total = int(blocks.sum())
    if total == len(size):
        out = np.add.reduceat(values, end - size)
    else:
        first = np.cumsum(blocks) - blocks
        number = np.arange(total) - np.repeat(first, blocks)
        part = mix(np.add.reduceat(values, np.repeat(end - size, blocks) + number * BLOCK), 17)
        part *= np.where(number > 0, mix(number.astype(_U), 23) | _U(1), _U(1))
        # A word of one block is the block's sum, in whatever company it is hashed.
        out = np.where(blocks > 1, np.add.reduceat(part, first), np.add.reduceat(values, end - size))
    return mix(out + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def _trimmed(run):
    """``run``, after which the worker, which Spark keeps for later tasks, gives back the memory it no longer uses."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return whole


def map_batches(rows: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` of wide rows. The session's rows per Arrow batch are lowered to ``BATCH_ROWS`` if it has more."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return rows.mapInArrow(_trimmed(run), schema)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)``; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = column.buffers()[2] if n else None
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """The words of a chunk: byte positions, hashes, and for each text its first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True, breaks: np.ndarray = SPACE):
        n = len(data)
        solid = ~breaks[data]
        first = np.empty(n, bool)
        if n:
            first[0] = True
            np.logical_not(solid[:-1], out=first[1:])
            first[offs[:-1][offs[:-1] < n]] = True
        self.start = np.flatnonzero(solid & first)
        last = np.empty(n, bool)
        if n:
            last[-1] = True
            np.logical_not(solid[1:], out=last[:-1])
            last[offs[1:-1][(offs[1:-1] > 0)] - 1] = True
        self.end = np.flatnonzero(solid & last) + 1
        self.bounds = np.searchsorted(self.start, offs)
        self.hash = word_hashes(data[solid], self.end - self.start, lower)

    def grams(self, k: int) -> np.ndarray:
        """The hash of words i to i+k-1 for each i that has so many words after it in the chunk."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, _U)
        at = np.arange(n)
        return runs(self.hash, at, at + k, "word")
