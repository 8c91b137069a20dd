"""Writes small sorted BAM files with an index, for tests only."""

from __future__ import annotations

import re
import struct
import zlib

_OPS = "MIDNSHP=X"
_CODES = {b: i for i, b in enumerate("=ACMGRSVTWYHKDBN")}


def _block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<2I", zlib.crc32(data), len(data))


_EOF = _block(b"")


def _record(row: dict, ids: dict[str, int]) -> bytes:
    codes = [int(n) << 4 | _OPS.index(op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    seq = row["seq"] or ""
    nibbles = [_CODES.get(b, 15) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2]))
    name = row["qname"].encode() + b"\0"
    tags = b"NMi" + struct.pack("<i", 3) + b"XBBS" + struct.pack("<i2H", 2, 1, 2)
    if row.get("sa"):
        tags += b"SAZ" + row["sa"].encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ids.get(row["contig"], -1), row["pos0"], len(name), row["mapq"], 0, len(codes),
                       row["flag"], len(seq), -1, -1, 0)
    body += name + struct.pack(f"<{len(codes)}I", *codes) + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def write_bam(path: str, contigs: list[tuple[str, int]], rows: list[dict], block_bytes: int = 2000) -> None:
    """Rows must be sorted by (contig order, pos0)."""
    ids = {name: i for i, (name, _) in enumerate(contigs)}
    text = b"@HD\tVN:1.6\tSO:coordinate\n"
    header = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    for name, length in contigs:
        header += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    windows = [{} for _ in contigs]
    starts: list[list[int]] = [[] for _ in contigs]
    mapped = [0] * len(contigs)
    with open(path, "wb") as out:
        out.write(_block(header))
        pending = b""
        for row in rows:
            raw = _record(row, ids)
            at = out.tell() << 16 | len(pending)
            if row["contig"] in ids:
                i = ids[row["contig"]]
                mapped[i] += 0 if row["flag"] & 4 else 1
                if not starts[i]:
                    starts[i].append(at)
                for w in range(row["pos0"] >> 14, (max(row["ref_end"] - 1, row["pos0"]) >> 14) + 1):
                    windows[i].setdefault(w, at)
            pending += raw
            while len(pending) >= block_bytes:
                out.write(_block(pending[:block_bytes]))
                pending = pending[block_bytes:]
        if pending:
            out.write(_block(pending))
        out.write(_EOF)
    with open(path + ".bai", "wb") as out:
        out.write(b"BAI\1" + struct.pack("<i", len(contigs)))
        for i in range(len(contigs)):
            bins = [(0, [(s, s)]) for s in starts[i]] + [(37450, [(0, 0), (mapped[i], 0)])]
            out.write(struct.pack("<i", len(bins)))
            for number, chunks in bins:
                out.write(struct.pack("<Ii", number, len(chunks)))
                for a, b in chunks:
                    out.write(struct.pack("<QQ", a, b))
            n = max(windows[i], default=-1) + 1
            offsets, last = [], 0
            for w in range(n):
                last = windows[i].get(w, last)
                offsets.append(last)
            out.write(struct.pack("<i", n) + struct.pack(f"<{n}Q", *offsets))
