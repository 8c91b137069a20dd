"""Byte-level BPE by a rank file: encoding and decoding.

Every match of the pattern is encoded for itself. Over the byte positions of a match stands a segment tree whose
leaves hold the rank of the pair that begins there (a sentinel for none); every node holds the smallest rank of its
part, the leftmost position winning ties. A merge takes the root's pair, joins the token with its live right
neighbour and renews three leaves: its own, its left neighbour's and the swallowed one's, each in logarithmic time.
Matches of like length are worked on together: one step of the loop below is one merge in each of them.

Nulls and empty texts have no tokens. Nothing depends on other rows, so repeated rows repeat their result; an
empty table gives an empty result; extra columns are ignored. A very long match is a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import columns_of
from .text import give_back, once, slices

#: Encoded matches that a Python worker remembers.
REMEMBERED = 300_000
_NONE = np.int64(2**31 - 1)


class Ranks:
    """A rank file: tokens' bytes, and the rank that a pair of tokens merges into."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.tokens = {rank: token for token, rank in by_bytes.items()}
        self.single = np.array([by_bytes[bytes([b])] for b in range(256)], np.int64)
        self.by_bytes = by_bytes
        pairs = {}
        for token, rank in by_bytes.items():
            for k in range(1, len(token)):
                left, right = by_bytes.get(token[:k]), by_bytes.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        bits = max(4, (len(pairs) * 3).bit_length())
        self._shift = np.uint64(64 - bits)
        self._keys, self._ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE)
        keys, ranks = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        slot, self._probes = self._slot(keys), 0
        while len(keys):  # linear probing: whoever finds a free slot takes it, the rest go one further
            self._probes += 1
            free = self._keys[slot] == -1
            won = np.zeros(len(keys), bool)
            _, one = np.unique(slot[free], return_index=True)
            won[np.flatnonzero(free)[one]] = True
            self._keys[slot[won]], self._ranks[slot[won]] = keys[won], ranks[won]
            keys, ranks, slot = keys[~won], ranks[~won], (slot[~won] + 1) % len(self._keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into, or the sentinel; a negative token merges with nothing."""
        keys = left << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.where(self._keys[slot] == keys, self._ranks[slot], _NONE)
        open_ = np.flatnonzero((self._keys[slot] != keys) & (self._keys[slot] != -1))
        for _ in range(self._probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % len(self._keys)
            found = self._keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def ranks_of(path: str) -> Ranks:
    return once(("ranks", path), lambda: Ranks(path))


def encode_matches(matches: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Token ids of each match; whole matches that are tokens need no merge."""
    out: list[list[int]] = [[] for _ in matches]
    by_size: dict[int, list[int]] = {}
    for i, m in enumerate(matches):
        rank = ranks.by_bytes.get(m)
        if rank is not None:
            out[i] = [rank]
        elif m:
            by_size.setdefault(1 << (len(m) - 1).bit_length(), []).append(i)
    for size, members in by_size.items():
        most = max(1, (1 << 19) // size)
        for at in range(0, len(members), most):
            group = members[at:at + most]
            for i, ids in zip(group, _merge([matches[i] for i in group], size, ranks), strict=True):
                out[i] = ids
    return out


def _merge(matches: list[bytes], size: int, ranks: Ranks) -> list[list[int]]:
    """Merges of matches of at most ``size`` bytes (a power of two), one tree for each."""
    n = len(matches)
    length = np.array([len(m) for m in matches])
    raw = np.frombuffer(b"".join(m.ljust(size, b"\0") for m in matches), np.uint8).reshape(n, size)
    token = np.where(np.arange(size) < length[:, None], ranks.single[raw], -1)
    after = np.concatenate([token[:, 1:], np.full((n, 1), -1)], axis=1)
    # A node is rank * size + position: its minimum is the smallest rank, leftmost.
    tree = np.full((n, 2 * size), _NONE * size)
    tree[:, size:] = ranks.pair(token.ravel(), after.ravel()).reshape(n, size) * size + np.arange(size)
    for level in range(size.bit_length() - 1, 0, -1):
        low = 1 << (level - 1)
        tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
    follows = np.tile(np.arange(1, size + 1), (n, 1))
    follows[np.arange(size) >= length[:, None] - 1] = -1
    precedes = np.tile(np.arange(-1, size - 1), (n, 1))
    flat = tree.ravel()

    def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        node, base = size + at, rows * (2 * size)
        flat[base + node] = rank * size + at
        while size > 1 and node[0] > 1:
            node = node >> 1
            flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])

    live = np.arange(n)
    while size > 1:
        root = tree[live, 1]
        live, root = live[root < _NONE * size], root[root < _NONE * size]
        if not len(live):
            break
        at, rank = root % size, root // size
        gone = follows[live, at]
        right = follows[live, gone]
        left = precedes[live, at]
        token[live, at], token[live, gone] = rank, -1
        follows[live, at] = right
        has = right >= 0
        precedes[live[has], right[has]] = at[has]
        put(live, gone, np.full(len(live), _NONE))
        put(live, at, ranks.pair(rank, np.where(has, token[live, right], -1)))
        back = left >= 0
        if back.any():
            put(live[back], left[back], ranks.pair(token[live[back], left[back]], rank[back]))
    keep = token >= 0
    flat_ids, cuts = token[keep].tolist(), np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).tolist()
    return [flat_ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Encoder:
    """Encodes whole texts, remembering the ids (as 32-bit numbers) of matches that came before."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.pattern = ranks_of(path), regex.compile(pattern)
        top = max(self.ranks.tokens, default=-1) + 1
        self.decimal = [str(i) for i in range(top)]
        self.bytes = [self.ranks.tokens.get(i, b"") for i in range(top)]
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text."""
        found = [self.pattern.findall(t) for t in texts]
        here = set(chain.from_iterable(found))
        if len(self.known) > REMEMBERED:  # what these texts need stays
            self.known = {m: self.known[m] for m in here.intersection(self.known)}
        new = list(here.difference(self.known))
        for m, ids in zip(new, encode_matches([m.encode() for m in new], self.ranks), strict=True):
            self.known[m] = array("I", ids).tobytes()
        for matches in found:
            yield array("I", b"".join(map(self.known.__getitem__, matches))).tolist()


def encoder_of(path: str, pattern: str) -> Encoder:
    return once(("encoder", path, pattern), lambda: Encoder(path, pattern))


def _encode(path: str, pattern: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                rows = []
                for ids in encoder.encode(texts):
                    decoded = b"".join(map(encoder.bytes.__getitem__, ids))
                    rows.append((len(ids), ids, decoded.decode()) if full else (
                        len(ids), hashlib.sha256(",".join(map(encoder.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                n, ids, decoded = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32()) if full else pa.string()), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids", "decoded"])
        encoder.known = {}
        give_back()
    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded (the ids turned back into text): one row for each row of ``docs``."""
    return columns_of(docs, "doc_id", "text").mapInArrow(
        _encode(path, pattern, True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``encode``, with SHA-256 digests in place of the ids (decimal, joined by commas) and of the decoded bytes."""
    return columns_of(docs, "doc_id", "text").mapInArrow(
        _encode(path, pattern, False), "doc_id long, n_tokens long, ids string, decoded string").select(
        "doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ranks_of(path).tokens
        for batch in batches:
            texts = [None if x is None else b"".join(tokens[i] for i in x).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return columns_of(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
