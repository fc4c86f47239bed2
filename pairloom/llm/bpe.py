"""Byte-pair encoding and decoding over a minimal acyclic transducer of frequent words.

The lexicon compiles frequent pre-tokens into one automaton that shares prefixes and suffixes. Each arc carries the
number of words that come before those it leads to, so the sum along a path numbers the word, and the number leads to
the word's ids. The compiled arrays are one file, sent to the executors once and memory-mapped by their workers. All
pre-tokens of a chunk walk the automaton together. Words it lacks are merged exactly, pair by pair in the order of the
tokenizer's ranks, and kept in a bounded cache. The lexicon saves work and never decides ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.pretok import pretokens
from pairloom.llm.shared import open_shared, rename_shared
from pairloom.llm.textvec import _TABLE, chunks, map_batches, runs
from pairloom.storage import materialise, shared_dir

#: The most words of a lexicon, and of the counts that a task gathers before it hands them on.
LEXICON_WORDS, TASK_WORDS = 1 << 16, 200_000
#: Bytes of the words in a worker's cache; when it is full, or half its table is, it starts anew.
CACHE_BYTES = 1 << 26
#: Words of more bytes are merged one by one.
MATRIX_BYTES = 48
_U = np.uint64
_NONE = np.int32(2**31 - 1)


class Hashed:
    """An open-addressing table from 64-bit keys to 32-bit values, read and written in bulk."""

    def __init__(self, bits: int, keys: np.ndarray | None = None, values: np.ndarray | None = None):
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, _U) if keys is None else keys
        self.values = np.full(1 << bits, -1, np.int32) if values is None else values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for absent keys."""
        slot = self._slot(keys)
        out = self.values[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        mask = len(self.keys) - 1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            v = self.values[slot[todo]]
            out[todo] = v
            todo = todo[(v >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are absent."""
        slot, mask = self._slot(keys), len(self.keys) - 1
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.values[at] < 0
            got, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.keys[got], self.values[got] = keys[won], values[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            todo = todo[left[todo]]
            taken = self.values[slot[todo]] >= 0
            slot[todo[taken]] = (slot[todo[taken]] + 1) & mask
        self.n += len(keys)


def _byte_chars() -> list[str]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


class Vocabulary:
    """The ids, merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        chars = _byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        vocab = model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        table = [b""] * self.size
        for token, i in vocab.items():
            table[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            table[i] = token
        self.bytes = table
        self.byte_ids = np.array([vocab[c] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = Hashed(18)
        self.ranks.put((left << 32 | right).astype(_U), np.arange(len(pairs), dtype=np.int32))
        self._rank = dict(zip(zip(left.tolist(), right.tolist()), range(len(pairs))))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        got = self.ranks.get((left.astype(np.int64) << 32 | right.astype(np.int64)).astype(_U))
        got[got < 0] = _NONE
        return got

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one word of any length, in n log n steps."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self._rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for p, q in ((before[i], i), (i, k)):
                if p >= 0 and q >= 0 and (s := self._rank.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids one after another, number of each)`` of the words ``data[start:end]``."""
        size = end - start
        counts = np.zeros(len(size), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, MATRIX_BYTES)):
            rows = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(rows), 1 << 14):
                of = rows[at : at + (1 << 14)]
                ids, n = self._merge_matrix(data, start[of], size[of], high)
                counts[of] = n
                parts.append((of, ids, n))
        long = {i: self.merge_long(data[start[i] : end[i]].tobytes()) for i in np.flatnonzero(size > MATRIX_BYTES).tolist()}
        for i, ids in long.items():
            counts[i] = len(ids)
        offs = np.zeros(len(size) + 1, np.int64)
        np.cumsum(counts, out=offs[1:])
        flat = np.zeros(offs[-1], np.int32)
        for of, ids, n in parts:
            cols = np.arange(ids.shape[1])
            full = cols < n[:, None]
            flat[(offs[of][:, None] + cols)[full]] = ids[full]
        for i, ids in long.items():
            flat[offs[i] : offs[i + 1]] = ids
        return flat, counts

    def _merge_matrix(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        cols = np.arange(width)
        inside = cols < size[:, None]
        ids = np.where(inside, self.byte_ids[data[np.minimum(start[:, None] + cols, len(data) - 1)]], -1)
        n = size.copy()
        rank = np.full(ids.shape, _NONE, np.int32)
        pair = inside[:, 1:]
        rank[:, :-1][pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])
        live = np.arange(len(n))
        a, r = ids.copy(), rank
        while len(live):
            at = r.argmin(1)
            row = np.arange(len(live))
            best = r[row, at]
            on = best != _NONE
            if not on.all():
                done = live[~on]
                ids[done] = a[~on]
                live, a, r, at, best = live[on], a[on], r[on], at[on], best[on]
                row = row[: len(live)]
                if not len(live):
                    break
            a[row, at] = self.merged[best]
            src = np.minimum(cols + (cols > at[:, None]), width - 1)
            a = np.take_along_axis(a, src, 1)
            a[:, -1] = -1
            src = np.minimum(cols + (cols >= at[:, None] + 1), width - 1)
            r = np.take_along_axis(r, src, 1)
            r[:, -1] = _NONE
            n[live] -= 1
            for shift in (-1, 0):
                p = at + shift
                ok = p >= 0
                left = a[row, np.maximum(p, 0)]
                right = a[row, np.minimum(np.maximum(p, 0) + 1, width - 1)]
                valid = ok & (right >= 0) & (np.maximum(p, 0) + 1 < width)
                got = np.full(len(row), _NONE, np.int32)
                got[valid] = self.rank(left[valid], right[valid])
                r[row[ok], p[ok]] = got[ok]
        return ids, n

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


class Pool:
    """A growing array."""

    def __init__(self, dtype, size: int = 1 << 16):
        self.data, self.used = np.zeros(size, dtype), 0

    def add(self, values: np.ndarray) -> None:
        while self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start[i]`` to ``start[i] + size[i]`` of all i, one after another."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


class WordCache:
    """Ids of the words met so far; ``encode`` gives those of new words.

    A hash leads to a row, and the row's bytes are compared with the word's on each hit, so a word whose hash belongs to
    another one is encoded anew and never gets the other's ids.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], bits: int = 21):
        self.encode, self.bits = encode, bits
        self._reset()

    def _reset(self) -> None:
        self.table = Hashed(self.bits)
        self._flat, self._offs, self._bytes, self._ends = Pool(np.int32), Pool(np.int64), Pool(np.uint8), Pool(np.int64)
        self._offs.add(np.zeros(1, np.int64))
        self._ends.add(np.zeros(1, np.int64))

    def forget(self) -> None:
        """Give up the words met so far."""
        self._reset()

    @property
    def flat(self) -> np.ndarray:
        return self._flat.data

    @property
    def offs(self) -> np.ndarray:
        return self._offs.data

    def _append(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """New rows for these words."""
        ids, counts = self.encode(data, start, end)
        rows = self._offs.used - 1 + np.arange(len(start))
        self._offs.add(self._flat.used + np.cumsum(counts))
        self._ends.add(self._bytes.used + np.cumsum(end - start))
        self._flat.add(ids)
        self._bytes.add(data[spread(start, end - start)])
        return rows

    def _differ(self, row: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which words aren't those of their rows."""
        size, own = end - start, self._ends.data
        out = own[row + 1] - own[row] != size
        same = np.flatnonzero(~out)
        unequal = data[spread(start[same], size[same])] != self._bytes.data[spread(own[row[same]], size[same])]
        if unequal.any():
            out[same[np.searchsorted(np.cumsum(size[same]), np.flatnonzero(unequal), "right")]] = True
        return np.flatnonzero(out)

    def rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The row of each word, after which ``offs`` and ``flat`` have its ids."""
        if self._offs.used > (1 << self.bits) // 2 or self._bytes.used > CACHE_BYTES:
            self._reset()
        row = self.table.get(hashes).astype(np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            if self.table.n + len(keys) > (1 << self.bits) * 3 // 4:
                big, self.bits = self.bits, max(self.bits, int(len(hashes)).bit_length() + 2)
                self._reset()
                out = self.rows(data, start, end, hashes)
                self.bits = big
                return out
            of = new[first]
            self.table.put(keys, self._append(data, start[of], end[of]).astype(np.int32))
            row = self.table.get(hashes).astype(np.int64)
        other = self._differ(row, data, start, end)
        if len(other):
            row[other] = self._append(data, start[other], end[other])
        return row


class Lexicon:
    """The compiled transducer: ``arcs`` maps state * 256 + byte to a row of ``to`` and ``skip``; state 0 is the root."""

    FIELDS = ("keys", "values", "to", "skip", "final", "flat", "offs")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update({k: arrays[k] for k in self.FIELDS})
        self.arcs = Hashed(int(len(self.keys)).bit_length() - 1, self.keys, self.values)

    @classmethod
    def compile(cls, words: list[bytes], ids: list[np.ndarray]) -> Lexicon:
        """``words`` are distinct; they are sorted here, since the automaton is built in order."""
        order = sorted(range(len(words)), key=words.__getitem__)
        words, ids = [words[i] for i in order], [ids[i] for i in order]
        register: dict[tuple, int] = {}
        nodes: list[tuple[bool, tuple]] = []

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(nodes)
                nodes.append(key)
            return register[key]

        path: list[list] = [[False, []]]
        before = b""
        for word in words:
            same = len(os.path.commonprefix([before, word]))
            while len(path) > same + 1:
                state = close(path.pop())
                path[-1][1].append((before[len(path) - 1], state))
            for _ in word[same:]:
                path.append([False, []])
            path[-1][0] = True
            before = word
        while len(path) > 1:
            state = close(path.pop())
            path[-1][1].append((before[len(path) - 1], state))
        root = close(path.pop())

        total = []
        keys, to, skip = [], [], []
        for state, (final, arcs) in enumerate(nodes):
            seen = int(final)
            for byte, target in arcs:
                keys.append(state << 8 | byte)
                to.append(target)
                skip.append(seen)
                seen += total[target]
            total.append(seen)
        bits = max(4, int(2 * len(keys)).bit_length())
        arcs = Hashed(bits)
        arcs.put(np.array(keys, _U), np.arange(len(keys), dtype=np.int32))
        offs = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=offs[1:])
        return cls(
            {
                "keys": arcs.keys, "values": arcs.values, "to": np.array([*to, root], np.int32), "skip": np.array([*skip, 0], np.int32),
                "final": np.array([f for f, _ in nodes], bool), "flat": np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32), "offs": offs,
            }
        )

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those the lexicon lacks."""
        out = np.full(len(start), -1, np.int64)
        live, at, stop = np.arange(len(start)), start, end
        state = np.full(len(start), int(self.to[-1]), np.int64)
        number = np.zeros(len(start), np.int64)
        while len(live):
            over = at == stop
            if over.any():
                good = over & self.final[state]
                out[live[good]] = number[good]
                on = ~over
                live, at, stop, state, number = live[on], at[on], stop[on], state[on], number[on]
                if not len(live):
                    break
            arc = self.arcs.get((state << 8 | data[at]).astype(_U))
            on = arc >= 0
            if not on.all():
                live, at, stop, number, arc = live[on], at[on], stop[on], number[on], arc[on]
            state, number, at = self.to[arc].astype(np.int64), number + self.skip[arc], at + 1
        return out

    def pack(self) -> bytes:
        """One file: a header with the place of each array, then the arrays."""
        head, at, body = {}, 0, []
        for k in self.FIELDS:
            x = getattr(self, k)
            head[k] = (str(x.dtype), len(x), at)
            raw = x.tobytes()
            body += [raw, b"\0" * (-len(raw) % 64)]
            at += len(raw) + len(body[-1])
        return b"".join([json.dumps(head).encode().ljust(1024), *body])

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Memory-mapped: workers of one machine share the pages."""
        raw = np.memmap(path, np.uint8, "r")
        head = json.loads(raw[:1024].tobytes())
        return cls({k: np.frombuffer(raw, np.dtype(t), n, 1024 + at) for k, (t, n, at) in head.items()})


class Encoder:
    """Ids of whole texts, chunk by chunk."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None, encode: Callable | None = None, bits: int = 21):
        self.vocab, self.lexicon = vocab, lexicon
        self.cache = WordCache(encode or vocab.merge, bits)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: text i has ``ids[bounds[i]:bounds[i + 1]]``."""
        special = self._special(data, offs)
        ends = offs if not special else np.unique(np.concatenate([offs, [p for s, e, _ in special for p in (s, e)]]))
        start = pretokens(data, ends)
        forced = {}
        if special:
            drop = np.zeros(len(data) + 1, bool)
            for s, e, i in special:
                drop[s + 1 : e] = True
                forced[s] = i
            start = start[~drop[start]]
        end = np.r_[start[1:], len(data)][: len(start)]
        row = np.full(len(start), -1, np.int64)
        if self.lexicon is not None:
            row = self.lexicon.find(data, start, end)
        rest = np.flatnonzero(row < 0)
        size = np.zeros(len(start), np.int64)
        src = np.zeros(len(start), np.int64)
        if self.lexicon is not None:
            known = np.flatnonzero(row >= 0)
            src[known] = self.lexicon.offs[row[known]]
            size[known] = self.lexicon.offs[row[known] + 1] - src[known]
        got = self.cache.rows(data, start[rest], end[rest], runs(_TABLE[data], start[rest], end[rest], "byte")) if len(rest) else np.zeros(0, np.int64)
        src[rest] = self.cache.offs[got]
        size[rest] = self.cache.offs[got + 1] - src[rest]
        if forced:
            at = np.searchsorted(start, list(forced))
            size[at] = 1
        bounds = np.zeros(len(start) + 1, np.int64)
        np.cumsum(size, out=bounds[1:])
        ids = np.empty(bounds[-1], np.int32)
        of_word = np.repeat(np.arange(len(start)), size)
        place = src[of_word] + (np.arange(bounds[-1]) - bounds[:-1][of_word])
        cached = np.zeros(len(start), bool)
        cached[rest] = True
        if forced:
            cached[at] = False
            place[bounds[at]] = 0
        from_cache = cached[of_word]
        ids[from_cache] = self.cache.flat[place[from_cache]]
        if self.lexicon is not None:
            ids[~from_cache] = self.lexicon.flat[place[~from_cache]] if len(self.lexicon.flat) else 0
        if forced:
            ids[bounds[at]] = list(forced.values())
        return ids, bounds[np.searchsorted(start, offs)]

    def _special(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
        raw = None
        out: list[tuple[int, int, int]] = []
        for token, i in self.vocab.special.items():
            if (data == token[0]).any():
                raw = raw or data.tobytes()
                at = raw.find(token)
                while at >= 0:
                    if offs[np.searchsorted(offs, at, "right")] >= at + len(token):
                        out.append((at, at + len(token), i))
                        at = raw.find(token, at + len(token))
                    else:
                        at = raw.find(token, at + 1)
        return sorted(out)


def build_lexicon(docs: DataFrame, vocab: Vocabulary, words: int = LEXICON_WORDS) -> Lexicon:
    """From the most frequent pre-tokens of all documents, counted in each task first; ids don't depend on it.

    At most ``words`` come to the driver, of ``MATRIX_BYTES`` at most.
    """
    count = map_batches(docs.select(F.col("text").cast("string").alias("text")), _word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Frequencies are put into classes, eight to each doubling, so nothing is sorted and no task sends its own best.
    count = materialise(count.where("n > 1").withColumn("class", F.floor(F.log2("n") * 8)), "counts")
    least, left = None, words
    for r in sorted(count.groupBy("class").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["class"]):
        if r.n > left:
            break
        least, left = r["class"], left - r.n
    rows = count.where(F.col("class") >= least).select("word").collect() if least is not None else count.select("word").limit(words).collect()
    top = [w for w in sorted(bytes(r.word) for r in rows) if w not in vocab.special]
    data = np.frombuffer(b"".join(top), np.uint8)
    end = np.cumsum([len(w) for w in top], dtype=np.int64) if top else np.zeros(0, np.int64)
    start = np.r_[0, end[:-1]].astype(np.int64) if top else end
    flat, counts = vocab.merge(data, start, end)
    return Lexicon.compile(top, np.split(flat, np.cumsum(counts)[:-1]) if top else [])


def _word_counts(batches):
    """Counts of one task; longer words than ``MATRIX_BYTES`` are left to exact merging."""
    count: dict[bytes, int] = {}

    def handed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], ["word", "n"])
        count.clear()
        return out

    for batch in batches:
        for _, _, data, offs in chunks(batch.column(0)):
            start = pretokens(data, offs)
            end = np.r_[start[1:], len(data)][: len(start)]
            short = end - start <= MATRIX_BYTES
            start, end = start[short], end[short]
            if not len(start):
                continue
            _, first, n = np.unique(runs(_TABLE[data], start, end, "byte"), return_index=True, return_counts=True)
            raw = data.tobytes()
            for s, e, c in zip(start[first].tolist(), end[first].tolist(), n.tolist()):
                word = raw[s:e]
                count[word] = count.get(word, 0) + c
        if len(count) > TASK_WORDS:
            yield handed()
    if count:
        yield handed()


_loaded: dict[str, Encoder] = {}


def _encoder(raw, name: str) -> Encoder:
    """A worker's encoder; its lexicon is mapped from the file that came with the job."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Encoder(Vocabulary(raw.value), Lexicon.load(SparkFiles.get(name)), bits=18)
    return _loaded[name]


def bpe(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) for each row of ``docs(doc_id, text)``.

    Ids are those that the tokenizers library gives for the whole text without special tokens; a special token's string
    in a text is that token, as there. Null texts are empty: no ids, and the hashes of nothing. Repeated rows stay.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    vocab = Vocabulary(content)
    lexicon = build_lexicon(docs, vocab)
    packed = lexicon.pack()
    name = f"pairloom-lexicon-{hashlib.sha256(packed).hexdigest()[:20]}"
    path = f"{shared_dir(spark)}/pairloom/{name}"
    with open_shared(f"{path}.part", "wb") as f:
        f.write(packed)
    rename_shared(f"{path}.part", path)
    spark.sparkContext.addFile(path)
    raw = spark.sparkContext.broadcast(content)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        encoder = _encoder(raw, name)
        for batch in batches:
            for at, to, data, offs in chunks(batch.column(1)):
                ids, bounds = encoder(data, offs)
                wide = ids.astype("<u4")
                n = np.diff(bounds)
                coded, plain = [], []
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    coded.append(hashlib.sha256(wide[s:e]).hexdigest())
                    plain.append(hashlib.sha256(encoder.vocab.decode(ids[s:e]).encode()).hexdigest())
                columns = [batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(coded), pa.array(plain)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        # The worker outlives the task; the lexicon has the frequent words, so the others' ids are cheap to lose.
        encoder.cache.forget()

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)
