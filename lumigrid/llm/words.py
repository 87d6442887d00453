"""Words of many texts at once, from their UTF-8 bytes, with 64-bit hashes; no Python object per word.

A word is a maximal run of bytes outside a separator table. Separators are ASCII, so runs never cut a
code point. Hashes are sums of byte values times position keys (mod 2**64), mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    """A byte table that is true in the closed ranges."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Space and \t \n \v \f \r.
SPACES = table_of((0x20, 0x20), (0x09, 0x0D))
#: All ASCII but digits and letters (lower-cased texts: upper-case letters don't occur).
NOT_ALNUM = table_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
NEWLINE = table_of((0x0A, 0x0A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE_KEYS = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_PLACE_KEYS = mix((np.arange(1 << 12, dtype=np.uint64) + np.uint64(1000)) * _STEP) | np.uint64(1)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 bounds in them; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each non-empty byte range."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    cum = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(cum, lens)
    keys = _PLACE_KEYS[place] if lens.max() <= len(_PLACE_KEYS) else mix((place.astype(np.uint64) + np.uint64(1000)) * _STEP) | np.uint64(1)
    place += np.repeat(starts, lens)
    return mix(np.add.reduceat(_BYTE_KEYS[data[place]] * keys, cum) + lens.astype(np.uint64))


def hash_of(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data])
    return hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends)


def runs(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators; a text's bounds end a run."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    off = separator[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, off[:-1]
    full = bounds[:-1][np.diff(bounds) > 0]
    first[full] = True
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, off[1:]
    last[full[1:] - 1] = True
    return np.flatnonzero(first & ~off), np.flatnonzero(last & ~off) + 1


@dataclass
class Words:
    data: np.ndarray
    bounds: np.ndarray  # of texts, in data
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # words of text i: first[i]:first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside one text, and the word each begins at."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        at = np.flatnonzero(left >= k)
        out = self.hash[at].copy()
        for j in range(1, k):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += self.hash[at + j]
        return mix(out), at


def scan(texts: pa.Array, separator: np.ndarray = SPACES, lower: bool = False) -> Words:
    data, bounds = raw(texts)
    if lower:
        data = LOWER[data]
    starts, ends = runs(data, bounds, separator)
    return Words(data, bounds, starts, ends, hashes(data, starts, ends), np.searchsorted(starts, bounds))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per byte or word) over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
