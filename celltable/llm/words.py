"""Words of UTF-8 texts as numpy arrays, for use inside Arrow tasks.

A batch of texts is one byte array with row offsets.  Words are maximal runs of word bytes inside one row; each
gets a 64-bit fingerprint mixed from its bytes and its length.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)
LONG_WORD = 64


def byte_classes(pattern: str) -> np.ndarray:
    """Word bytes of one of two word patterns: ``space`` is ``[^\\x20\\x09-\\x0D]+``, ``alnum`` keeps 0-9, a-z and all
    bytes of non-ASCII characters."""
    table = np.ones(256, bool)
    if pattern == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        table[:0x30] = table[0x3A:0x61] = table[0x7B:0x80] = False
    else:
        raise ValueError(f"unknown word pattern {pattern!r}")
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def mix(h: np.ndarray, x) -> np.ndarray:
    """One mixing step of a 64-bit fingerprint; order matters."""
    h = (h ^ x) * _K1
    h ^= h >> _S29
    h *= _K2
    h ^= h >> _S32
    return h


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


@dataclass
class Words:
    """Words of a run of rows: byte range and fingerprint of each word, and the first word of each row."""

    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(data: np.ndarray, off: np.ndarray, word_bytes: np.ndarray, fold: np.ndarray | None = None,
                seed: int = 0) -> Words:
    off = np.asarray(off, np.int64)
    if fold is not None:
        data = fold[data]
    inside = word_bytes[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = off[1:]
    after[ends[(ends > 0)] - 1] = False
    stop = np.flatnonzero(inside & ~after) + 1
    return Words(start, stop, _hashes(data, start, stop, seed), np.searchsorted(start, off))


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int) -> np.ndarray:
    """Eight bytes a step; the few words beyond LONG_WORD bytes go one by one, in the same steps."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    keep = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 8)] + [2**64 - 1], np.uint64)
    size = stop - start
    h = mix(np.full(len(start), np.uint64(seed * 2 + 1)), size.astype(np.uint64))
    live = np.arange(len(start))
    for at in range(0, LONG_WORD, 8):
        live = live[size[live] > at]
        if not len(live):
            return h
        part = eight[start[live] + at] & keep[np.minimum(size[live] - at, 8)]
        h[live] = mix(h[live], part)
    for i in live[size[live] > LONG_WORD]:
        tail = np.zeros(-(-int(size[i] - LONG_WORD) // 8) * 8, np.uint8)
        tail[:size[i] - LONG_WORD] = data[start[i] + LONG_WORD:stop[i]]
        h[i] = _fold_long(h[i:i + 1], tail.view("<u8"))
    return h


def _fold_long(h: np.ndarray, parts: np.ndarray) -> np.uint64:
    """Fingerprint of a very long word: its parts are mixed with their positions and summed."""
    salted = mix(np.arange(1, len(parts) + 1, dtype=np.uint64), parts)
    return mix(h, np.add.reduce(salted))[0]


def prefixes(data: np.ndarray, words: Words, size: int, fold: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the first ``size`` (at most 8) bytes of every word."""
    padded = np.concatenate([data if fold is None else fold[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(size + 1)], np.uint64)
    return mix(np.full(len(words.start), np.uint64(size)), eight[words.start] & keep[np.minimum(words.stop - words.start, size)])


def windows(words: Words, size: int, short: str = "none") -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, fingerprint) of every run of ``size`` words of one row.

    ``short``: rows with fewer words give none ("none") or their whole sequence as one window ("whole")."""
    n = np.diff(words.first)
    left = np.repeat(words.first[1:], n) - np.arange(len(words.hash))
    at = np.flatnonzero(left >= size)
    h = np.full(len(at), np.uint64(size))
    for k in range(size):
        h = mix(h, words.hash[at + k])
    if short == "whole":
        rows = np.flatnonzero((n > 0) & (n < size))
        s = n[rows].astype(np.uint64)
        for k in range(size - 1):
            more = n[rows] > k
            s[more] = mix(s[more], words.hash[words.first[rows[more]] + k])
        at, h = np.append(at, words.first[rows]), np.append(h, s)
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
    return at, h


def pieces(off: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; one longer row makes a run of its own."""
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as byte planes of their gaps: small gaps leave planes of zeros, which compress."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpack(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def planes(values: np.ndarray) -> bytes:
    """Integers in any order as byte planes."""
    values = np.ascontiguousarray(values)
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def from_planes(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(dtype).ravel()
