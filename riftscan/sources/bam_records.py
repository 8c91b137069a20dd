"""BAM records as columns: numpy views of many records at once, to Arrow and back.

Formats follow the public SAM/BAM specification. A record is known by where its body starts; all fields of a batch are
gathered by index arithmetic, so nothing runs once per record but the chain of record lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of the format.
OPS = b"MIDNSHP=X"
BASES = b"=ACMGRSVTWYHKDBN"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
#: Operations that advance on the reference.
_ADVANCES = np.isin(np.arange(16), [0, 2, 3, 7, 8])
HEAD = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("name_len", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"),
                 ("n_bases", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("span", "<i4")])
ARROW = pa.schema([
    ("qname", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("pos0", pa.int64()), ("ref_end", pa.int64()),
    ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("query_length", pa.int32()), ("sa", pa.string()),
])

_SIZE = np.full(256, -1)
for _kind, _bytes in TAG_SIZES.items():
    _SIZE[ord(_kind)] = _bytes
_TWO_BASES = np.stack([np.frombuffer(BASES, np.uint8)[np.arange(256) >> 4], np.frombuffer(BASES, np.uint8)[np.arange(256) & 15]], axis=1)
_NIBBLE = np.full(256, 15, np.uint8)
_NIBBLE[np.frombuffer(BASES, np.uint8)] = np.arange(16)
_OP_OF = np.full(256, 255, np.uint8)
_OP_OF[np.frombuffer(OPS, np.uint8)] = np.arange(len(OPS))


def places(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of all ranges, one after another."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


def _offsets(length: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(length)])


def _strings(flat: np.ndarray, length: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    text = pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(_offsets(length).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
    return text if valid is None else pc.if_else(pa.array(valid), text, pa.scalar(None, pa.string()))


def chain(data: bytes, at: int, limit: int | None) -> tuple[list[int], int]:
    """Where the bodies of the whole records from ``at`` on begin, up to records that start at ``limit``; and where the next starts."""
    found, size = [], len(data)
    while at + 4 <= size and (limit is None or at < limit):
        after = at + 4 + int.from_bytes(data[at:at + 4], "little")
        if after > size:
            break
        found.append(at + 4)
        at = after
    return found, at


class Records:
    """Records of a piece of decompressed data, narrowed by ``keep`` before anything costly is decoded."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> None:
        self.data, self.at, self.end = data, at, end
        self.head = data[at[:, None] + np.arange(HEAD.itemsize)].view(HEAD).reshape(-1)
        self._codes: tuple[np.ndarray, np.ndarray] | None = None
        self._tags: dict[str, tuple[np.ndarray, np.ndarray]] | None = None

    def keep(self, mask: np.ndarray) -> Records:
        return self if mask.all() else Records(self.data, self.at[mask], self.end[mask])

    def __len__(self) -> int:
        return len(self.at)

    def field(self, name: str) -> np.ndarray:
        return self.head[name].astype(np.int64)

    def _after_name(self) -> np.ndarray:
        return self.at + HEAD.itemsize + self.field("name_len")

    def tags(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Start and length (bytes) of SA texts and CG arrays; -1 without. All records go on to their next tag together."""
        if self._tags is None:
            bases = self.field("n_bases")
            at = self._after_name() + 4 * self.field("n_ops") + (bases + 1) // 2 + bases
            none = np.full(len(self), -1)
            sa, sa_len, cg, cg_len = none.copy(), none.copy(), none.copy(), none.copy()
            ends = np.append(np.flatnonzero(self.data == 0), len(self.data))
            active = np.flatnonzero(at + 3 <= self.end)
            while len(active):
                p = at[active]
                name, kind = self.data[p].astype(int) << 8 | self.data[p + 1], self.data[p + 2]
                p = p + 3
                size = _SIZE[kind]
                text = (kind == ord("Z")) | (kind == ord("H"))
                size[text] = ends[np.searchsorted(ends, p[text])] - p[text] + 1
                hit = text & (name == int.from_bytes(b"SA", "big"))
                sa[active[hit]], sa_len[active[hit]] = p[hit], size[hit] - 1
                several = np.flatnonzero(kind == ord("B"))
                item = self.data[p[several]]
                count = self.data[p[several][:, None] + np.arange(1, 5)].view("<i4").reshape(-1).astype(np.int64)
                size[several] = 5 + _SIZE[item] * count
                hit = several[(name[several] == int.from_bytes(b"CG", "big")) & (item == ord("I"))]
                cg[active[hit]], cg_len[active[hit]] = p[hit] + 5, size[hit] - 5
                if (size < 0).any():
                    raise ValueError("a record has a tag of unknown type")
                at[active] = p + size
                active = active[at[active] + 3 <= self.end[active]]
            self._tags = {"SA": (sa, sa_len), "CG": (cg, cg_len)}
        return self._tags

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """All CIGAR codes, and how many each record has; long ones come from the CG tag."""
        if self._codes is None:
            start, count = self._after_name(), self.field("n_ops")
            maybe = np.flatnonzero(count == 2)
            first = self.data[start[maybe][:, None] + np.arange(4)].view("<u4").reshape(-1)
            stand_in = maybe[first == (self.field("n_bases")[maybe] << 4 | 4)]
            if len(stand_in):
                at, length = self.tags()["CG"]
                stand_in = stand_in[at[stand_in] >= 0]
                start[stand_in], count[stand_in] = at[stand_in], length[stand_in] // 4
            self._codes = self.data[places(start, 4 * count)].view("<u4"), count
        return self._codes

    def ref_end(self) -> np.ndarray:
        codes, count = self.codes()
        owner = np.repeat(np.arange(len(self)), count)
        return self.field("pos") + np.bincount(owner, np.where(_ADVANCES[codes & 15], codes >> 4, 0), len(self)).astype(np.int64)

    def mapped(self) -> np.ndarray:
        return (self.field("ref") >= 0) & (self.field("flag") & 4 == 0)

    def column(self, name: str, contigs: pa.Array) -> pa.Array:
        if name == "qname":
            length = self.field("name_len") - 1
            return _strings(self.data[places(self.at + HEAD.itemsize, length)], length)
        if name == "contig":
            ref = self.field("ref")
            return contigs.take(pa.array(ref, mask=ref < 0))
        if name == "pos0":
            return pa.array(self.field("pos"))
        if name == "ref_end":
            return pa.array(self.ref_end(), mask=~self.mapped())
        if name == "cigar":
            return self._cigar_text()
        if name == "seq":
            bases = self.field("n_bases")
            packed = (bases + 1) // 2
            two = _TWO_BASES[self.data[places(self._after_name() + 4 * self.field("n_ops"), packed)]].reshape(-1)
            return _strings(two[places(2 * (np.cumsum(packed) - packed), bases)], bases, bases > 0)
        if name == "sa":
            at, length = self.tags()["SA"]
            some = np.maximum(length, 0)
            return _strings(self.data[places(at, some)], some, at >= 0)
        return pa.array(self.field({"query_length": "n_bases"}.get(name, name)).astype(np.int32))

    def _cigar_text(self) -> pa.Array:
        codes, count = self.codes()
        number = codes >> 4
        digits = 1 + sum((number >= 10**k).astype(np.int64) for k in range(1, 9))
        end = np.cumsum(digits + 1)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        out[end - 1] = np.frombuffer(OPS, np.uint8)[np.minimum(codes & 15, len(OPS) - 1)]
        for k in range(int(digits.max()) if len(digits) else 0):
            some = digits > k
            out[end[some] - 2 - k] = 48 + number[some] // 10**k % 10
        length = np.bincount(np.repeat(np.arange(len(self)), count), digits + 1, len(self)).astype(np.int64)
        return _strings(out, length, count > 0)


def decode(records: Records, contigs: pa.Array, columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([records.column(c, contigs).cast(ARROW.field(c).type) for c in columns], columns)


def reg2bin(begin: np.ndarray, end: np.ndarray, shift: int, depth: int) -> np.ndarray:
    """The smallest bin that holds [begin, end)."""
    out = np.zeros(len(begin), np.int64)
    open_ = np.ones(len(begin), bool)
    for level in range(depth, 0, -1):
        width = shift + 3 * (depth - level)
        fits = open_ & (begin >> width == (end - 1) >> width)
        out[fits] = ((1 << 3 * level) - 1) // 7 + (begin[fits] >> width)
        open_ &= ~fits
    return out


def _text(column: pa.Array, null: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of a text column."""
    column = pc.fill_null(column.cast(pa.large_string()), null)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    flat = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return flat, np.diff(offsets)


def _codes_of(flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CIGAR texts to codes, and how many each record has."""
    is_op = (flat < 48) | (flat > 57)
    op_at = np.flatnonzero(is_op)
    edges = _offsets(length)
    owner = np.searchsorted(edges, op_at, "right") - 1
    begin = np.maximum(np.concatenate([[0], op_at[:-1] + 1]) if len(op_at) else op_at, edges[owner])
    digits, number = op_at - begin, np.zeros(len(op_at), np.int64)
    for k in range(int(digits.max()) if len(digits) else 0):
        some = digits > k
        number[some] += (flat[op_at[some] - 1 - k].astype(np.int64) - 48) * 10**k
    op = _OP_OF[flat[op_at]]
    if (op == 255).any() or (digits == 0).any() or int(is_op.sum()) and edges[-1] and not is_op[-1]:
        raise ValueError("not a CIGAR text")
    return (number << 4 | op).astype("<u4"), np.bincount(owner, minlength=len(length))


def encode(batch: pa.RecordBatch, contigs: dict[str, int]) -> tuple[bytes, dict[str, np.ndarray]]:
    """Records of a batch (columns of ``ARROW``; ref_end and query_length follow from the others), and what an index needs of them."""
    rows = batch.num_rows
    name, name_len = _text(batch.column("qname"), "*")
    cigar, cigar_len = _text(batch.column("cigar"))
    seq, bases = _text(batch.column("seq"))
    sa, sa_len = _text(batch.column("sa"))
    has_sa = np.asarray(batch.column("sa").is_valid())
    codes, n_ops = _codes_of(cigar, cigar_len)
    if n_ops.size and n_ops.max() > 0xFFFF:
        raise ValueError("records of more than 65535 operations can't be written")
    if name_len.size and name_len.max() > 254:
        raise ValueError("read names of more than 254 bytes can't be written")
    coded = batch.column("contig").dictionary_encode()
    numbers = np.array([*(contigs.get(c, -1) for c in coded.dictionary.to_pylist()), -1])
    ref = numbers[np.asarray(pc.fill_null(coded.indices, len(numbers) - 1))]
    pos = np.asarray(pc.fill_null(batch.column("pos0"), -1)).astype(np.int64)
    owner = np.repeat(np.arange(rows), n_ops)
    end = pos + np.bincount(owner, np.where(_ADVANCES[codes & 15], codes >> 4, 0), rows).astype(np.int64)
    packed, tag_len = (bases + 1) // 2, np.where(has_sa, sa_len + 4, 0)
    size = HEAD.itemsize + name_len + 1 + 4 * n_ops + packed + bases + tag_len
    out = np.zeros(int((size + 4).sum()), np.uint8)
    at = np.cumsum(size + 4) - size - 4
    head = np.zeros(rows, np.dtype([("size", "<i4"), ("head", HEAD)]))
    head["size"] = size
    flag = np.asarray(pc.fill_null(batch.column("flag"), 0))
    for key, value in {"ref": ref, "pos": pos, "name_len": name_len + 1, "mapq": np.asarray(pc.fill_null(batch.column("mapq"), 255)), "n_ops": n_ops,
                       "flag": flag, "n_bases": bases, "mate_ref": -1, "mate_pos": -1, "bin": reg2bin(pos, np.maximum(end, pos + 1), 14, 5) & 0xFFFF}.items():
        head["head"][key] = value
    out[(at[:, None] + np.arange(head.itemsize)).ravel()] = np.frombuffer(head.tobytes(), np.uint8)
    p = at + head.itemsize
    out[places(p, name_len)] = name
    p = p + name_len + 1
    out[places(p, 4 * n_ops)] = codes.view(np.uint8)
    p = p + 4 * n_ops
    inside = np.arange(len(seq)) - np.repeat(np.cumsum(bases) - bases, bases)
    target, nibble = np.repeat(p, bases) + inside // 2, _NIBBLE[seq]
    out[target[inside % 2 == 0]] = nibble[inside % 2 == 0] << 4
    out[target[inside % 2 == 1]] |= nibble[inside % 2 == 1]
    p = p + packed
    out[places(p, bases)] = 0xFF
    p = (p + bases)[has_sa]
    out[(p[:, None] + np.arange(3)).ravel()] = np.tile(np.frombuffer(b"SAZ", np.uint8), len(p))
    out[places(p + 3, sa_len[has_sa])] = sa
    return out.tobytes(), {"ref": ref, "begin": pos, "end": np.maximum(end, pos + 1), "at": at, "mapped": (ref >= 0) & (flag & 4 == 0)}
