"""Vectorised views of Arrow string columns: byte buffers, words and rolling hashes.

Words are `[^\\x20\\x09-\\x0D]+`. All hashes are polynomials modulo 2**64 over mixed values, so any span's hash is a
difference of prefix sums; nothing here loops over words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # a worker holds about 100 bytes for each byte of a chunk

_U = np.uint64
_BYTE_MULT, _WORD_MULT, _SPAN_MULT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` holds about `limit` bytes at most; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1, start + 1)
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Gives freed memory back to the system, as workers live on after their task. Only glibc has the second call."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task: one thing at a time, so that no operator's caches lie idle under another's."""
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Lets go of what earlier tasks of the worker left."""
    if _HELD or _POWERS:
        _HELD.clear()
        _POWERS.clear()
        release()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser; changes nothing in place."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[65:91] = _BYTE_VALUES[97:123]


def _powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**i and mult**-i modulo 2**64 for i below n."""
    have = _POWERS.get(mult)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (mult, pow(mult, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[mult] = (out[0], out[1])
    return have


def prefix_sums(values: np.ndarray, mult: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(mult, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, mult: int) -> np.ndarray:
    """Hash of the values [start, stop) whatever stands before them; the length counts."""
    raw = (sums[stop] - sums[start]) * _powers(mult, len(sums))[1][start]
    return mix(raw ^ ((stop - start).astype(np.uint64) * _U(0xE7037ED1A0B428DB)))


class Words:
    """The words of a string column: byte starts and stops, the row of each word, the first word of each row."""

    def __init__(self, column: pa.Array, fold: bool = False, hashes: bool = True):
        self.offsets, self.data = offsets, data = utf8(column)
        self.rows = len(column)
        inside = ~SEPARATOR[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = edge.copy(), edge
        before[1:-1] |= ~inside[:-1]
        after = edge.copy()
        after[1:-1] |= ~inside[1:]
        self.start = np.flatnonzero(inside & before[:-1])
        self.stop = np.flatnonzero(inside & after[1:]) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.bincount(self.row, minlength=self.rows)
        if hashes:
            sums = prefix_sums((_FOLDED_VALUES if fold else _BYTE_VALUES)[data], _BYTE_MULT)
            self.hash = span_hash(sums, self.start, self.stop, _BYTE_MULT)

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; those that cross rows are there too, see `whole`."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        at = np.arange(n)
        return span_hash(self.sums(seed), at, at + k, _WORD_MULT if not seed else _SPAN_MULT)

    def sums(self, seed: int = 0) -> np.ndarray:
        return prefix_sums(self.hash if not seed else mix(self.hash ^ _U(seed)), _WORD_MULT if not seed else _SPAN_MULT)

    def spans(self, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
        return span_hash(self.sums(seed), start, stop, _WORD_MULT if not seed else _SPAN_MULT)

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are of one row."""
        n = len(self) - k + 1
        return self.row[:n] == self.row[k - 1 :] if n > 0 else np.zeros(0, bool)
