"""Vectorised words, hashes and windows over the raw buffers of an Arrow string column.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``. UTF-8 continuation bytes are
all above 0x7F, so splitting bytes and splitting code points give the same words. Nothing here
loops over words in Python: every step is a numpy pass over one chunk of documents.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Text bytes handled at once, for which a dozen times that memory is needed; a longer document forms a chunk of its own.
CHUNK_BYTES = (1 << 18) - 1

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15
_Q = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers, _word_powers2 = _Powers(_P), _Powers(_Q), _Powers(0xA24BAED4963EE407)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def relax() -> None:
    """Gives memory that is free in this worker back to the machine, which its executor shares."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Text(NamedTuple):
    """A chunk of documents: bytes, document offsets in them, and nulls."""

    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray


def text_of(column: pa.Array) -> Text:
    """Zero-copy view of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    null = np.asarray(column.is_null())
    return Text(data, offsets, null)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Text]]:
    """Runs [a, b) of rows with at most ``size`` bytes of text, or one row."""
    text = text_of(column)
    a, n = 0, len(text.null)
    while a < n:
        b = int(np.searchsorted(text.offsets, text.offsets[a] + size, "right")) - 1
        b = min(n, max(a + 1, b))
        lo, hi = text.offsets[a], text.offsets[b]
        yield a, b, Text(text.data[lo:hi], text.offsets[a : b + 1] - lo, text.null[a:b])
        a = b


class Words(NamedTuple):
    """starts, ends: byte bounds of each word; first: index of each document's first word, with a final end; hash: 64 bits a word."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words_of(text: Text, lower: bool = False) -> Words:
    data = LOWER[text.data] if lower else text.data
    space = _SPACE[data]
    before = np.empty_like(space)
    if len(space):
        before[0] = True
        before[1:] = space[:-1]
        inner = text.offsets[1:-1]
        before[inner[inner < len(space)]] = True
    begin = ~space & before
    starts = np.flatnonzero(begin)
    # a word ends before the next space or the next document's first byte
    stop = np.empty_like(space)
    if len(space):
        stop[-1] = True
        stop[:-1] = space[1:]
        inner = text.offsets[1:-1]
        stop[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(~space & stop) + 1
    up, down = _byte_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(starts, ends, np.searchsorted(starts, text.offsets), hashes)


def windows(words: Words, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one document.

    Positions whose window would leave the document are False in the second array.
    """
    n = len(words.hash)
    out, fits = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n >= k:
        up, down = (_word_powers2 if second else _word_powers)(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        source = mix(words.hash ^ np.uint64(0x5851F42D4C957F2D)) if second else words.hash
        np.cumsum(source * up[:-1], out=sums[1:])
        out[: n - k + 1] = mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])
        last = np.repeat(words.first[1:], np.diff(words.first))
        fits = np.arange(n) + k <= last
    return out, fits


def owners(first: np.ndarray) -> np.ndarray:
    """The document index of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
