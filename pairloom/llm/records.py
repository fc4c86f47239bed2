"""Token ids as length-delimited binary records, with an offset index beside each file.

A record is: payload length (unsigned 64-bit), masked CRC of those eight bytes, payload, masked CRC of the payload. A CRC
is zlib's CRC-32, masked by rotating it right by 15 bits and adding a constant, so that checksums of data that itself
holds checksums stay sound. A payload is: doc_id (signed 64-bit), bytes an id takes (2 or 4, unsigned 32-bit), number of
ids (unsigned 32-bit), ids. All numbers are little-endian. The index of ``x.rec`` is ``x.idx``: for each record its
doc_id (signed 64-bit), byte offset (unsigned 64-bit) and number of ids (unsigned 64-bit), so a shuffled read seeks.

Files are written by range of doc_id, to a temporary name that is renamed when complete; a task that runs again writes
the same files. A task starts another file when one has ``FILE_BYTES``, so files and indexes stay bounded whatever the
data. Null texts are empty and hold the end id alone. Rows that share an id stay, ordered by text. Reading goes by the
index, and a record that isn't what its index says is corrupt.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from pairloom.llm.bpe import Encoder, Vocabulary
from pairloom.llm.shared import open_shared, rename_shared
from pairloom.llm.textvec import chunks, map_batches
from pairloom.storage import fresh_path

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
#: A file that has so many bytes takes no further record.
FILE_BYTES = 1 << 28
#: Numbers of files are those of their tasks times this, and their place.
FILES_OF_TASK = 1_000_000
_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<qII")
_MASK = 0xA282EAD8


class CorruptRecord(ValueError):
    pass


def masked_crc(data) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray, width: int) -> bytes:
    body = _BODY.pack(doc_id, width, len(ids)) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(body))
    return b"".join((size, struct.pack("<I", masked_crc(size)), body, struct.pack("<I", masked_crc(body))))


def read_record(f, offset: int | None = None) -> tuple[int, np.ndarray] | None:
    """The record at ``offset``, or the next one; None at the end."""
    if offset is not None:
        f.seek(offset)
    head = f.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or _HEAD.unpack(head)[1] != masked_crc(head[:8]):
        raise CorruptRecord("length")
    body = f.read(_HEAD.unpack(head)[0])
    tail = f.read(4)
    if len(tail) < 4 or struct.unpack("<I", tail)[0] != masked_crc(body):
        raise CorruptRecord("payload")
    doc_id, width, n = _BODY.unpack_from(body)
    return doc_id, np.frombuffer(body, f"<u{width}", n, _BODY.size)


def _library(tokenizer) -> callable:
    """Ids of distinct pre-tokens from the tokenizers library."""

    def encode(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        words = [raw[s:e].decode("utf-8") for s, e in zip(start.tolist(), end.tolist())]
        ids = [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum())), counts

    return encode


_made: dict[int, Encoder] = {}


def _encoder(content: bytes) -> Encoder:
    """A worker's encoder, kept from task to task."""
    key = zlib.crc32(content)
    if key not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made.clear()
        _made[key] = Encoder(Vocabulary(content), encode=_library(Tokenizer.from_str(content.decode())))
    return _made[key]


class RecordFile:
    """One file of records and its index, under temporary names until it is closed."""

    def __init__(self, path: str):
        self.path, self.own = path, f"{path}.{uuid.uuid4().hex}"
        self.index, self.bytes, self.tokens = array("q"), 0, 0
        self.file = open_shared(f"{self.own}.rec", "wb")

    def add(self, doc_id: int, ids: np.ndarray, width: int) -> None:
        record = frame(doc_id, ids, width)
        self.file.write(record)
        self.index.extend((doc_id, self.bytes, len(ids)))
        self.bytes += len(record)
        self.tokens += len(ids)

    def close(self) -> tuple[str, int, int]:
        """``path, n_docs, n_tokens``."""
        self.file.close()
        index = np.frombuffer(self.index, np.int64).astype("<i8")
        with open_shared(f"{self.own}.idx", "wb") as f:
            f.write(index.tobytes())
        rename_shared(f"{self.own}.idx", f"{self.path}.idx")
        rename_shared(f"{self.own}.rec", f"{self.path}.rec")
        return self.path, len(index) // 3, self.tokens


def write_records(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs(doc_id, text)`` to record files in ascending doc_id order; returns one row for each file.

    ``part, path, n_docs, n_tokens``: files in ascending ``part`` hold ascending ids.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "records")
    with open(tokenizer_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def run(batches) -> Iterator[pa.RecordBatch]:
        task, number, out = TaskContext.get().partitionId(), 0, None
        encoder = width = None
        done = []
        for batch in batches:
            if encoder is None and batch.num_rows:
                encoder = _encoder(raw.value)
                width = 2 if encoder.vocab.size <= 1 << 16 else 4
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, data, offs in chunks(batch.column(1)):
                ids, bounds = encoder(data, offs)
                for i, s, e in zip(doc_ids[lo:hi], bounds[:-1].tolist(), bounds[1:].tolist()):
                    if out is None or out.bytes >= file_bytes:
                        if out is not None:
                            done.append((task * FILES_OF_TASK + number, *out.close()))
                            number += 1
                        out = RecordFile(f"{folder}/part-{task:06d}-{number:06d}")
                    out.add(i, np.append(ids[s:e], end_id), width)
        if out is not None:
            done.append((task * FILES_OF_TASK + number, *out.close()))
            parts, paths, n, tokens = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(paths), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = map_batches(rows, run, "part long, path string, n_docs long, n_tokens long")
    # One row for each file, kept on the driver: the writing runs once, whatever reads follow.
    found = [tuple(r) for r in files.collect()]
    return spark.createDataFrame(sorted(found), "part long, path string, n_docs long, n_tokens long")


def read_index(path: str) -> np.ndarray:
    with open_shared(f"{path}.idx", "rb") as f:
        return np.frombuffer(f.read(), INDEX)


def read_records(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each record, found by its index: start counts the ids before it."""
    spark = files.sparkSession
    rows, start = [], 0
    for part, path, _, n in sorted(tuple(r) for r in files.collect()):
        rows.append((part, path, start))
        start += n
    schema = "part long, path string, start long"
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, path, at in zip(*(c.to_pylist() for c in batch.columns)):
                index = read_index(path)
                starts = at + np.r_[0, np.cumsum(index["n"].astype(np.int64))]
                with open_shared(f"{path}.rec", "rb") as f:
                    for lo in range(0, len(index), 10_000):
                        part = index[lo : lo + 10_000]
                        crcs = [zlib.crc32(ids.astype("<u4")) for ids in _by_index(f, part)]
                        columns = [part["doc_id"], starts[lo : lo + len(part)], part["n"].astype(np.int64), np.array(crcs, np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    if f.read(1):
                        raise CorruptRecord("more than the index has")

    paths = spark.createDataFrame(rows, schema).repartition(len(rows), "part") if len(rows) > 1 else spark.createDataFrame(rows, schema)
    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _by_index(f, entries: np.ndarray) -> Iterator[np.ndarray]:
    for doc_id, offset, n in entries.tolist():
        record = read_record(f, None if f.tell() == offset else offset)
        if record is None or record[0] != doc_id or len(record[1]) != n:
            raise CorruptRecord("not what the index says")
        yield record[1]


def read_at(path: str, numbers: list[int]) -> list[tuple[int, np.ndarray]]:
    """Records of one file by their place in it, in the order asked for, each by one seek."""
    entries = read_index(path)[numbers]
    with open_shared(f"{path}.rec", "rb") as f:
        return list(zip(entries["doc_id"].tolist(), _by_index(f, entries)))
