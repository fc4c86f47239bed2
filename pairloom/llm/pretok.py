"""Splitting texts into pre-tokens the way a byte-level tokenizer does, for a whole chunk of bytes at once.

The rule is the public byte-level one: contractions, then runs of letters, of numbers or of other marks, each with one
space before it, then white space. The class of a character is asked of the tokenizers library itself the first time it
is seen, so both agree on every Unicode version.
"""

from __future__ import annotations

import numpy as np
from tokenizers.pre_tokenizers import ByteLevel

LETTER, NUMBER, OTHER, BLANK, UNKNOWN = 0, 1, 2, 3, 255
_classes = np.full(0x110000, UNKNOWN, np.uint8)
_byte_level = ByteLevel(add_prefix_space=False)
#: What may follow an apostrophe as one token.
CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def _class_of(point: int) -> int:
    char = chr(point)
    for probe, kind in (("a", LETTER), ("1", NUMBER), (".", OTHER)):
        if len(_byte_level.pre_tokenize_str(probe + char)) == 1:
            return kind
    return BLANK


def classify(points: np.ndarray) -> np.ndarray:
    out = _classes[points]
    if (out == UNKNOWN).any():
        for p in np.unique(points[out == UNKNOWN]).tolist():
            _classes[p] = _class_of(p)
        out = _classes[points]
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    ascii_table = classify(np.arange(128))
    wide = np.flatnonzero(data >= 0xC0)
    out = ascii_table[data & 0x7F]
    if len(wide):
        lead = data[wide].astype(np.int64)
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        last = len(data) - 1
        tail = [data[np.minimum(wide + i, last)].astype(np.int64) & 0x3F for i in (1, 2, 3)]
        point = np.where(
            size == 2, (lead & 0x1F) << 6 | tail[0],
            np.where(size == 3, (lead & 0x0F) << 12 | tail[0] << 6 | tail[1], (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]),
        )
        kind = classify(point)
        for i in range(4):
            of = size > i
            out[wide[of] + i] = kind[of]
    return out


def pretokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The byte positions at which pre-tokens start; ``offs`` are the ends of texts, which no token crosses."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    cut = np.zeros(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[offs] = True
    cut[n] = True
    edge = np.flatnonzero(cut)
    run_start, run_end = edge[:-1], edge[1:]
    ends_text = np.zeros(n + 1, bool)
    ends_text[offs] = True
    blank = kind[run_start] == BLANK
    inner = blank & ~ends_text[run_end]
    end = run_end[inner]
    last = end - 1
    while (back := (data[last] & 0xC0) == 0x80).any():
        last = last - back
    cut[last] = True
    cut[end[data[last] == 0x20]] = False

    quote = run_start[(run_end - run_start == 1) & (data[run_start] == 0x27)]
    if len(quote):
        joined = (quote > 0) & ~ends_text[quote] & (data[np.maximum(quote - 1, 0)] == 0x20)
        stop = offs[np.searchsorted(offs, quote, "right")]
        for q, e in zip(quote[~joined].tolist(), stop[~joined].tolist()):
            after = data[q + 1 : min(q + 3, e)].tobytes()
            for c in CONTRACTIONS:
                if after.startswith(c):
                    cut[q + 1] = False
                    if q + 1 + len(c) < e:
                        cut[q + 1 + len(c)] = True
                    break
    return np.flatnonzero(cut[:n])
