"""Vectorised word scanning over UTF-8 bytes, shared by the operators that hash words.

Texts of an Arrow batch are joined into one byte array (a space between texts), so
that lower-casing, word boundaries and 64-bit word hashes are a few numpy passes
over a bounded chunk. Only A-Z is lower-cased, as the operators' contracts say.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass looks at; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
_MULT = 0x9E3779B97F4A7C15 | 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_HASH = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)


def _table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes of words: all but the given ranges."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: Words are runs of anything but ASCII white space.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of ASCII letters, digits and all characters beyond ASCII.
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        base = np.full(size, _MULT, np.uint64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
        base[1:] = pow(_MULT, -1, 2**64)
        _inverse = np.multiply.accumulate(base)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Words of a run of texts. first[i]:first[i + 1] are the words of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def phrase(self, i: int, n: int) -> bytes:
        """n words from i, joined by single spaces."""
        return b" ".join([self.word(j) for j in range(i, i + n)])

    def owner(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def scan(texts: list[bytes], word_bytes: np.ndarray) -> Chunk:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)] if texts else np.zeros(0, np.uint8)
    inside = word_bytes[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[0::2], edges[1::2]
    first = np.searchsorted(starts, offsets)
    _grow(len(data))
    if len(starts):
        masked = np.where(word_bytes, _BYTE_HASH, np.uint64(0))
        sums = np.add.reduceat(masked[data] * _powers[: len(data)], starts)
        hashes = mix(sums * _inverse[starts] + (ends - starts).astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Chunk(data, starts, ends, first, hashes, offsets)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, across text borders too; callers drop those."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + len(out)]
    return mix(out + np.uint64(n))


def window_starts(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """True where n consecutive words from here stay within one text."""
    ok = np.zeros(max(0, total - n + 1), bool)
    counts = np.diff(first)
    long = counts >= n
    begin, end = first[:-1][long], first[1:][long] - n + 1
    flips = np.zeros(len(ok) + 1, np.int32)
    np.add.at(flips, begin, 1)
    np.add.at(flips, end, -1)
    return np.cumsum(flips[:-1]) > 0


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most ``limit`` bytes, one text at least."""
    begin = held = 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)
