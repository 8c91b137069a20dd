"""Indexes of BAM files (.bai and .csi): which bytes can hold the reads of a region."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable

import numpy as np

from .bam_records import reg2bin

BAI_SHIFT, BAI_DEPTH = 14, 5


def _first_of(level: int) -> int:
    return ((1 << 3 * level) - 1) // 7


class ContigIndex:
    """Bins of one contig: where each begins on the contig, and the offsets of its reads."""

    def __init__(self, shift: int, depth: int) -> None:
        self.shift, self.depth, self.mapped = shift, depth, 0
        #: Begin of the bin and offset of the first read, for every chunk.
        self.chunks: list[tuple[int, int]] = []
        #: Begin and first overlapping offset of bins by level (.csi), or offsets of 16 kb windows (.bai).
        self.first: list[list[tuple[int, int]]] = [[] for _ in range(depth + 1)]
        self.windows: tuple[int, ...] = ()

    def add(self, number: int, chunks: list[tuple[int, int]], first: int | None) -> None:
        if number == _first_of(self.depth + 1) + 1:  # statistics
            self.mapped = chunks[1][0]
            return
        level = next(k for k in range(self.depth + 1) if number < _first_of(k + 1))
        begin = (number - _first_of(level)) << (self.shift + 3 * (self.depth - level))
        self.chunks += [(begin, at) for at, _ in chunks]
        if first is not None:
            self.first[level].append((begin, first))

    def marks(self, first: int) -> list[int]:
        """Offsets at which reading may begin."""
        return sorted({o for o in (*(at for _, at in self.chunks), *self.windows, *(at for bins in self.first for _, at in bins)) if o >= first})

    def lower(self, start: int) -> int:
        """An offset that no read which reaches behind ``start`` comes before."""
        if self.windows:
            return self.windows[min(start >> self.shift, len(self.windows) - 1)]
        return max((at for bins in self.first for at in [max((b for b in bins if b[0] <= start), default=(0, 0))[1]]), default=0)

    def upper(self, stop: int) -> int | None:
        """An offset from which on all reads of the contig begin at ``stop`` or later: the first of a bin that does."""
        return min((at for begin, at in self.chunks if begin >= stop), default=None)


def parse(raw: bytes) -> list[ContigIndex]:
    if raw[:2] == b"\x1f\x8b":  # compressed in blocks, which are gzip members
        raw = gzip.decompress(raw)
    is_csi = raw[:4] == b"CSI\1"
    if not is_csi and raw[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    shift, depth, at = BAI_SHIFT, BAI_DEPTH, 4
    if is_csi:
        shift, depth, extra = struct.unpack_from("<3i", raw, 4)
        at = 16 + extra
    count, at, found = struct.unpack_from("<i", raw, at)[0], at + 4, []
    for _ in range(count):
        entry = ContigIndex(shift, depth)
        n_bins, at = struct.unpack_from("<i", raw, at)[0], at + 4
        for _ in range(n_bins):
            if is_csi:
                number, first, n = struct.unpack_from("<IQi", raw, at)
                at += 16
            else:
                (number, n), first = struct.unpack_from("<Ii", raw, at), None
                at += 8
            pairs = struct.unpack_from(f"<{2 * n}Q", raw, at)
            at += 16 * n
            entry.add(number, list(zip(pairs[::2], pairs[1::2], strict=True)), first)
        if not is_csi:
            n, at = struct.unpack_from("<i", raw, at)[0], at + 4
            entry.windows = struct.unpack_from(f"<{n}Q", raw, at)
            at += 8 * n
        found.append(entry)
    return found


def csi(contigs: list[tuple[str, int]], ref: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, after: np.ndarray, mapped: np.ndarray,
        shift: int = BAI_SHIFT) -> bytes:
    """Index of records in file order: contig number, range, offset, offset behind, and whether mapped; not yet compressed."""
    depth, longest = BAI_DEPTH, max((n for _, n in contigs), default=0)
    while longest > 1 << (shift + 3 * depth):
        depth += 1
    out = [b"CSI\1", struct.pack("<4i", shift, depth, 0, len(contigs))]
    for i in range(len(contigs)):
        mine = np.flatnonzero(ref == i)
        if not len(mine):
            out.append(struct.pack("<i", 0))
            continue
        bins = reg2bin(begin[mine], end[mine], shift, depth)
        reach = np.maximum.accumulate(end[mine])
        order = np.argsort(bins, kind="stable")
        fresh = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        gap = fresh.copy()
        gap[1:] |= np.diff(order) != 1  # reads of a bin that stand side by side are one chunk
        heads = np.flatnonzero(gap)
        tails = np.append(heads[1:], len(order)) - 1
        starts = np.flatnonzero(fresh)
        per_bin = np.diff(np.append(np.searchsorted(heads, starts), len(heads)))
        out.append(struct.pack("<i", len(starts) + 1))
        chunk = 0
        for s, n in zip(starts.tolist(), per_bin.tolist(), strict=True):
            number = int(bins[order[s]])
            level = next(k for k in range(depth + 1) if number < _first_of(k + 1))
            bin_begin = (number - _first_of(level)) << (shift + 3 * (depth - level))
            first = at[mine[int(np.searchsorted(reach, bin_begin, "right"))]]
            out.append(struct.pack("<IQi", number, int(first), n))
            for h, t in zip(heads[chunk:chunk + n].tolist(), tails[chunk:chunk + n].tolist(), strict=True):
                out.append(struct.pack("<QQ", int(at[mine[order[h]]]), int(after[mine[order[t]]])))
            chunk += n
        out.append(struct.pack("<IQi4Q", _first_of(depth + 1) + 1, 0, 2, int(at[mine[0]]), int(after[mine[-1]]), int(mapped[mine].sum()), int((~mapped[mine]).sum())))
    return b"".join(out)


def find(path: str, named: str | None, read: Callable[[str], bytes]) -> list[ContigIndex]:
    """The index of a BAM file: the named one, or .bai, or .csi."""
    for candidate in [named] if named else [f"{path}.bai", f"{path}.csi"]:
        try:
            return parse(read(candidate))
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"{path} has no index; index the file first")
