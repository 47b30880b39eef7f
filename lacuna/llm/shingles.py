"""Word and word n-gram hashes of whole batches of texts, vectorised over their bytes.

Texts come as Arrow string arrays of normalised text (words separated by single spaces),
so a batch is one byte buffer plus offsets and nothing is done per word in Python.  Only
numpy arithmetic inside tasks; Spark deals out the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text handled at once: bounds the working arrays (about 60 bytes for each).
CHUNK = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def normalised(text: str | Column) -> Column:
    """Lower case, letters and digits kept, anything else one space, trimmed; null is ''."""
    t = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift-xor and odd multiplication)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the odd base and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_M), -1, 1 << 64))
            for name, base in (("up", _M), ("down", inverse)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a))
        return self.up[:n], self.down[:n]


def _words_of(data: np.ndarray, powers: _Powers):
    """Start and hash of every word in a byte array of at most a chunk."""
    inside = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers.upto(len(data) + 1)
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * down[starts]
    return starts, mix64(raw ^ (ends - starts).astype(np.uint64))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string array (32- or 64-bit offsets)."""
    import pyarrow as pa
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o, d


def _chunks(offsets: np.ndarray, limit: int):
    """Ranges of whole texts with at most ``limit`` bytes (or one longer text)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(column, limit: int = CHUNK):
    """Yields (first text, one past the last, word hashes, bounds): text i of the range has
    the hashes bounds[i]:bounds[i + 1].  A text longer than a chunk is hashed in pieces that
    end at spaces and is yielded whole."""
    offsets, data = buffers(column)
    powers = _Powers()
    for i, j in _chunks(offsets, limit):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= limit:
            # texts have no space at their ends, so each but the last gets a separator
            local = offsets[i:j + 1] - lo + np.arange(j - i + 1)
            block = np.full(hi - lo + (j - i), 32, np.uint8)
            keep = np.ones(len(block), bool)
            keep[local[1:] - 1] = False
            block[keep] = data[lo:hi]
            starts, hashes = _words_of(block, powers)
            yield i, j, hashes, np.searchsorted(starts, local)
            continue
        parts, at = [], lo
        while at < hi:
            cut = min(at + limit, hi)
            if cut < hi:
                back = np.flatnonzero(data[at:cut] == 32)
                if len(back):
                    cut = at + int(back[-1]) + 1
                else:  # one word longer than a chunk
                    ahead = np.flatnonzero(data[cut:hi] == 32)
                    cut = cut + int(ahead[0]) + 1 if len(ahead) else hi
            parts.append(_words_of(data[at:cut], powers)[1])
            at = cut
        hashes = np.concatenate(parts)
        yield i, j, hashes, np.array([0, len(hashes)])


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int):
    """n-gram hashes and their bounds; a text with 1 to n - 1 words has one gram of them all."""
    count = np.diff(bounds)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_bounds = np.concatenate([[0], np.cumsum(grams)])
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    total = int(out_bounds[-1])
    # position of each gram's first word
    first = np.arange(total) - np.repeat(out_bounds[:-1], grams) + np.repeat(bounds[:-1], grams)
    left = np.repeat(bounds[1:], grams) - first
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        word = padded[first + k]
        if len(count) and count.min() < n:
            word = np.where(left > k, word, np.uint64(k + 1))
        acc = (acc + word) * _GRAM
    return mix64(acc), out_bounds
