"""Texts of an Arrow column as bytes and word hashes, without a Python object per word."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_000_000  # bytes whose hashes are computed at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True  # fixed: the white space of the output contracts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return whole[ends[0]:ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes; a longer text is a part of its own."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def give_back() -> None:
    """Returns what this process has freed to the machine; allocators keep it otherwise, until the process ends."""
    _table.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's alone
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a task of mapInArrow, which gives its memory back when it ends: idle Python workers lie beside later stages."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads close values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first ``n`` powers of the base and of its inverse; one table serves all parts of usual size in a task."""
    usual = 1 << CHUNK.bit_length()
    return _table(usual if n <= usual else 1 << (n - 1).bit_length())


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair, from one running sum."""
    n = len(values)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of several texts: ``hashes`` of all, ``first[i]:first[i + 1]`` are those of text i; byte ``starts`` and ``ends``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, places: bool = False):
        n = len(offsets) - 1
        hashes, starts, ends = [], [], []
        at = 0
        while at < len(data):
            upto = min(at + CHUNK, len(data))
            if upto < len(data):  # back to a space, or on to the next one if a single word fills the part
                spaces = np.flatnonzero(_SPACE[data[at:upto]])
                while not len(spaces) and upto < len(data):
                    grown = min(upto + CHUNK, len(data))
                    spaces = np.flatnonzero(_SPACE[data[upto:grown]])[:1] + (upto - at)
                    upto = grown
                upto = at + int(spaces[-1]) + 1 if len(spaces) else len(data)
            part = data[at:upto]
            inside = ~_SPACE[part]
            cut = offsets[(offsets > at) & (offsets < upto)] - at
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            begins[cut[inside[cut]]] = True
            stops = inside.copy()
            stops[:-1] &= ~inside[1:]
            before = cut[cut > 0] - 1
            stops[before[inside[before]]] = True
            s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            hashes.append(span_hashes(part.astype(np.uint64) + np.uint64(1), s, e))
            starts.append(s + at)
            if places:
                ends.append(e + at)
            at = upto
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.empty(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets) if n else np.zeros(1, np.int64)

    @classmethod
    def of(cls, column: pa.Array, places: bool = False) -> Words:
        return cls(*utf8(column), places)

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on, over all texts; those beyond a text's end mean nothing."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        starts = np.arange(n)
        return span_hashes(self.hashes, starts, starts + size)
