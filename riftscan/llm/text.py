"""Words of text columns as numpy arrays, taken straight from Arrow buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside a
longer character, so the bytes can be split without decoding. Words are named by 64-bit hashes: a polynomial
over the bytes (from prefix sums, so that no Python loop runs over words) and a final mix.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20
_SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % 2**64))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self._factors = (base % 2**64, pow(base, -1, 2**64))
        self._tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self._tables[0]) < n:
            for k, table in enumerate(self._tables):
                step = np.uint64(pow(self._factors[k], len(table), 2**64))
                self._tables[k] = np.concatenate([table, table * step])
        return self._tables[0], self._tables[1]


_POWERS = Powers(_BASE)
_RANGE_POWERS = Powers(0xD1342543DE82EF95)


@dataclass
class Words:
    """Words of a few documents: name, document (index in the slice), first byte and byte after the last."""

    name: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: Index of each document's first word, and one more entry for the end.
    first: np.ndarray
    #: The slice's text, lower-cased where that was asked for.
    data: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.first) - 1


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and len + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of text; a longer document is a piece of its own."""
    lengths = np.diff(bytes_of(batch.column(text))[1])
    piece = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: idle Python workers should not hold what a task has used."""
    pa.default_memory_pool().release_unused()
    # The C library's own call for that, where it has one.
    trim = once("malloc_trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))
    if trim is not None:
        trim(0)


def once(key: object, make: Callable[[], object]):
    """What ``make`` gives, made once in a Python process.

    This package travels inside task closures, so its own module variables are new in every task; what a worker's
    tasks share is kept under a module name of its own.
    """
    kept = sys.modules.setdefault("riftscan_worker_cache", types.ModuleType("riftscan_worker_cache")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def words_of(column: pa.Array, lower: bool = False, outside: np.ndarray = _SPACE) -> Words:
    """``outside``: which of the 256 bytes lie between words."""
    data, offsets = bytes_of(column)
    inside = ~outside[data]
    if lower:
        data = _LOWER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(_word_names(data, start, end), doc, start, end, first, data)


def _word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    names = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(end, start[at] + _SEGMENT, "right")))
        a, b = int(start[at]), int(end[upto - 1])
        power, inverse = _POWERS.upto(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
        s, e = start[at:upto] - a, end[at:upto] - a
        names[at:upto] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = upto
    return names


class Ranges:
    """Hashes of ranges of consecutive names, from prefix sums."""

    def __init__(self, names: np.ndarray, salt: int = 0) -> None:
        power, self._inverse = _RANGE_POWERS.upto(len(names) + 1)
        self._sums = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(salted(names, salt) * power[: len(names)], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def as_lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of ``values`` cut at ``first`` (len + 1 offsets)."""
    flat = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat, kind))


class Lookup:
    """Positions of 64-bit keys in the sequence it was made from; -1 for others."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, (len(keys) * 4).bit_length())
        self._shift = np.uint64(64 - bits)
        self._keys = np.zeros(1 << bits, np.uint64)
        self._at = np.full(1 << bits, -1, np.int32)
        self._probes = 0
        at, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(at):  # linear probing: whoever finds a free slot takes it, the rest go one further
            self._probes += 1
            free = np.flatnonzero(self._at[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self._keys[slot[won]], self._at[slot[won]] = keys[at[won]], at[won]
            rest = np.ones(len(at), bool)
            rest[won] = False
            at, slot = at[rest], (slot[rest] + 1) % len(self._at)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self._at[slot]
        other = np.flatnonzero((out >= 0) & (self._keys[slot] != keys))
        out[other] = -1
        for _ in range(self._probes):
            if not len(other):
                break
            slot[other] = (slot[other] + 1) % len(self._at)
            there = self._at[slot[other]]
            hit = (there >= 0) & (self._keys[slot[other]] == keys[other])
            out[other[hit]] = there[hit]
            other = other[~hit & (there >= 0)]
        return out
