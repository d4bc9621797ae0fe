"""Word hashes straight from Arrow text buffers.

A word is a run of ASCII letters, digits and underscores and of bytes above
ASCII. Its 64-bit hash is a polynomial over its bytes, taken from prefix sums, so
a whole block of texts is hashed without a loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from saltmarsh.llm.worker import process_cache

# Bytes hashed at a time; a longer word is still hashed whole.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for every 64-bit value (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.is_word = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])

    def to(self, n: int) -> None:
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                ones = np.ones(n + 1, np.uint64)
                up, down = ones * self.base, ones * self.inverse
                up[0] = down[0] = 1
                self.up, self.down = np.cumprod(up), np.cumprod(down)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the bounds of each; null is empty."""
    size = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], size)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hash of every word, bounds of each text in them, and hashes of the first bytes of every word.

    A prefix hash of a word that is not longer than the prefix is zero.
    """
    data, offsets = text_bytes(column)
    powers = process_cache("hashes", "powers", Powers)
    is_word = powers.is_word[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = is_word[edges]
    ends[edges - 1] = is_word[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), np.uint64)
    heads = [np.zeros(len(start), np.uint64) for _ in prefixes]
    word = 0
    with np.errstate(over="ignore"):
        while word < len(start):
            low = start[word]
            last = max(word + 1, int(np.searchsorted(stop, low + CHUNK, "right")))
            chunk = data[low : stop[last - 1]]
            powers.to(len(chunk) + 1)
            sums = np.zeros(len(chunk) + 1, np.uint64)
            np.cumsum(powers.byte[chunk] * powers.up[: len(chunk)], out=sums[1:])
            a, b = start[word:last] - low, stop[word:last] - low
            hashes[word:last] = mix((sums[b] - sums[a]) * powers.down[a] + (b - a).astype(np.uint64))
            for head, size in zip(heads, prefixes):
                longer = b - a > size
                head[word:last][longer] = mix((sums[a[longer] + size] - sums[a[longer]]) * powers.down[a[longer]] + np.uint64(size << 8))
            word = last
    return hashes, np.searchsorted(start, offsets), heads
