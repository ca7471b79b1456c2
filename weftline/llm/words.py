"""The words of a batch of texts and their hashes, in numpy over the batch's bytes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import BLANKS

#: Bytes hashed at a time.
STEP = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_FACTOR = np.uint64(0x9E6C63D0876A9A47)
_powers = np.ones(1, np.uint64)


class Words(NamedTuple):
    """Words [^\\x20\\x09-\\x0D]+ of texts: the texts' bytes, where each word starts and ends in them, and the number of
    words before each text, and of all."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_in(texts: pa.Array) -> Words:
    """The words of an array of texts without nulls."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_BLANK[raw]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    border = offsets[(offsets > 0) & (offsets < len(raw))]
    begin[border] = inside[border]
    end[border - 1] = inside[border - 1]
    starts = np.flatnonzero(begin)
    return Words(raw, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes and its length, mixed."""
    global _powers
    sizes = words.ends - words.starts
    longest = int(sizes.max(initial=1))
    if len(_powers) < longest:
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(longest * 2, _FACTOR)])
    before = np.r_[0, np.cumsum(sizes)]
    out, at = np.empty(len(sizes), np.uint64), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(before, before[at] + STEP, "right")) - 1)
        size, start = sizes[at:to], words.starts[at:to]
        into = before[at:to] - before[at]
        place = np.arange(before[to] - before[at]) - np.repeat(into, size)
        value = (words.raw[np.repeat(start, size) + place].astype(np.uint64) + np.uint64(1)) * _powers[place]
        out[at:to] = np.add.reduceat(value, into)
        at = to
    return mixed(out * np.uint64(2) + np.uint64(1) + sizes.astype(np.uint64) * _FACTOR) if len(out) else out
