"""Vectorised word, hash and window arithmetic over batches of texts, for the Python operators.

A batch is one flat byte array with offsets; everything runs over all its texts at once, in chunks of
bounded bytes (one longer text makes a chunk of its own). Hashes are polynomials modulo 2^64 over
random byte values, taken from prefix sums and then mixed, so any run of bytes or words costs O(1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U = np.uint64
_MASK = (1 << 64) - 1
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Two independent hash families: byte values, byte base, word base.
_TABLES = [_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_WORD_BASES = [0xBF58476D1CE4E5B9 | 5, 0x94D049BB133111EB | 5]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown when asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = _U(base), _U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = [Powers(b) for b in _BASES]
_WORD_POWERS = [Powers(b) for b in _WORD_BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of values times powers; one longer than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.get(len(values))[0], out=out[1:])
    return out


def runs(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the runs [start, end), equal for equal runs wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers.get(len(sums))[1][starts])


def byte_prefix(data: np.ndarray, family: int = 0) -> np.ndarray:
    return prefix(_TABLES[family][data], _BYTE_POWERS[family])


def byte_runs(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    return runs(sums, starts, ends, _BYTE_POWERS[family])


def byte_windows(sums: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """Hashes of the `size` bytes from each place on; other hashes than those of byte_runs, and cheaper ones for all places."""
    x = sums[size:] - sums[:-size]
    x *= _BYTE_POWERS[family].get(len(sums))[1][: len(x)]
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def word_prefix(hashes: np.ndarray, family: int = 0) -> np.ndarray:
    return prefix(hashes, _WORD_POWERS[family])


def word_runs(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    return runs(sums, starts, ends, _WORD_POWERS[family])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each starts (one more than texts); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of runs of texts with at most `most` bytes, or of one longer text."""
    data, at = flat(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    return _TO_LOWER[data]


class Words:
    """Where the words of a chunk start and end in bytes, and each text's first word (one more than texts)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        word = ~_IS_SPACE[data]
        before = np.empty(len(data), bool)
        before[1:] = word[:-1]
        starts = at[:-1][at[:-1] < at[1:]]
        if len(data):
            before[0] = False
        before[starts] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.empty(len(data), bool)
        after[:-1] = word[1:]
        if len(data):
            after[-1] = False
        after[starts[1:] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def hashes(self, sums: np.ndarray, family: int = 0) -> np.ndarray:
        return byte_runs(sums, self.start, self.end, family)

    def within(self) -> np.ndarray:
        """Each word's place in its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)
