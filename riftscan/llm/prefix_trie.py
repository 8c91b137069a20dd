"""Conversations that begin alike, as a trie of their turns.

A node is a distinct sequence of first turns (role and text). Its members are the conversations that start with it; the
root has no turn and all of them. What a node would save if its turn were worked on once for all its members is
(members - 1) times the words of its turn.

Method. A turn becomes a 16-byte mark and a word count, a conversation the string of its marks. Strings are dealt to
shards by range, so a shard holds neighbours in the trie's order, and equal strings are one row there. Each shard writes
its part of the trie as balanced parentheses: (1) ``Parentheses`` keeps the least excess of blocks of bits in a tree, by
which the closing bit of every node is found and with it the subtree; (2) the rank of "()" pairs counts leaves; (3) sums
along the preorder count members and words. Only nodes that are open at a border between shards, the spines, are seen by
two shards: each shard tells their parts, which add up, and is told the neighbours' nearest strings so that a node is
counted where it is opened and a leaf where nothing follows. So a first turn that a third of all conversations share is
one row for each shard.

Defined results. Turns go by number (null first), then role, then text (null role or text: empty). Rows without a
conversation id are left out; repeated rows are turns of their own. A conversation without turns (after a rebuild) is a
member of the root only. Texts may be empty or very long: they don't travel past the first shuffle. Other columns are
ignored, and of columns that share a name the first counts. An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import columns_of, partitions, stored

#: Bytes of a turn's mark.
MARK = 16
#: Conversations whose ids are written as one text before a node's digest is taken.
ID_BLOCK = 4096
#: Turns that a shard holds on average.
SHARD_TURNS = 400_000

WORD = r"[^\\x20\\x09-\\x0D]+"


def ordered_turns(df: DataFrame) -> DataFrame:
    """(conv_id, place, mark, words): turns in their order, places from 1."""
    rows = columns_of(df, "conv_id", "turn", "role", "text").where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return rows.select("conv_id", place.alias("place"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("mark"),
                       F.expr(f"size(regexp_extract_all(text, '{WORD}', 0))").alias("words"))


def rebuilt(turns: DataFrame, every: int, borrowed: str) -> DataFrame:
    """Of ``ordered_turns``: each conversation c starts with the first ``borrowed`` turns of conversation c - c % every.

    Its own turns follow after as many of them (``borrowed`` is SQL over ``conv_id``). A conversation of which no turn is left
    comes with one row without place.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = turns.where("place = 1").select("conv_id", base.alias("base"), F.expr(borrowed).cast("int").alias("h"))
    first = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), "place", "mark", "words")
    taken = convs.join(first, "base").where("place <= h").select("conv_id", "place", "mark", "words")
    own = turns.withColumn("h", F.expr(borrowed).cast("int")).where("place > h").select(
        "conv_id", (F.col("place").cast("long") + F.lit(1 << 40)).alias("place"), "mark", "words")  # behind all that is borrowed
    bare = convs.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("mark"), F.lit(0).alias("words"))
    return taken.unionByName(own).unionByName(bare)


def _strings(turns: DataFrame) -> DataFrame:
    """(conv_id, path binary, words array) of each conversation; rows without place only name it."""
    marks = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "mark", "words"))))
    return turns.groupBy("conv_id").agg(marks.alias("t")).select(
        "conv_id", F.unhex(F.array_join("t.mark", "")).alias("path"), F.col("t.words").alias("words"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each string of a sorted partition: its copies' number, smallest id, and the digest of all their ids."""
    shard, names = TaskContext.get().partitionId(), ["shard", "path", "words", "ends", "conv_id", "sha256"]
    kinds = [pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
    now, done = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    def row():
        path, words, count, least, digest = now
        return shard, path, words, count, least, digest.hexdigest()

    for batch in batches:
        for path, words, count, least, ids in zip(*(batch.column(k).to_pylist() for k in ("path", "words", "n", "conv_id", "ids")), strict=True):
            if now is None or now[0] != path:
                if now is not None:
                    done.append(row())
                now = [path, words, 0, least, hashlib.sha256()]
            elif now[2]:
                now[4].update(b",")
            now[2] += count
            now[4].update(ids.encode())
        if len(done) > 10_000:
            yield out()
            done = []
    if now is not None:
        done.append(row())
    if done:
        yield out()


class Parentheses:
    """Balanced parentheses (1 opens, 0 closes) with the least excess of blocks of bits in a tree."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        blocks = max(1, -(-len(bits) // self.BLOCK))
        self._leaves = 1 << (blocks - 1).bit_length()
        padded = np.full(self._leaves * self.BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self._padded = padded
        self._least = np.empty(2 * self._leaves, np.int64)
        self._least[self._leaves:] = padded.reshape(-1, self.BLOCK).min(1)
        width = self._leaves // 2
        while width:
            self._least[width:2 * width] = self._least[2 * width:4 * width].reshape(-1, 2).min(1)
            width //= 2

    def _scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place from ``at`` to its block's end whose excess is at most the target; -1 without one."""
        found = np.full(len(at), -1)
        open_ = np.arange(len(at))
        for _ in range(self.BLOCK):
            hit = self._padded[at[open_]] <= target[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] % self.BLOCK != 0]
            if not len(open_):
                break
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The closing bit of each opening bit."""
        target = self.excess[opens] - 1
        close = np.full(len(opens), -1)
        inside = np.flatnonzero((opens + 1) % self.BLOCK != 0)
        close[inside] = self._scan(opens[inside] + 1, target[inside])
        rest = np.flatnonzero(close < 0)
        node, want = self._leaves + opens[rest] // self.BLOCK, target[rest]
        climbing = np.arange(len(rest))
        while len(climbing):  # up to the first right neighbour that goes as low
            right = (node[climbing] % 2 == 0) & (self._least[np.minimum(node[climbing] + 1, len(self._least) - 1)] <= want[climbing])
            node[climbing] = np.where(right, node[climbing] + 1, node[climbing] // 2)
            climbing = climbing[~right]
        falling = np.flatnonzero(node < self._leaves)
        while len(falling):  # and down to its first block that does
            node[falling] *= 2
            node[falling] += self._least[node[falling]] > want[falling]
            falling = falling[node[falling] < self._leaves]
        close[rest] = self._scan((node - self._leaves) * self.BLOCK, want)
        return close

    def leaf_pairs(self) -> np.ndarray:
        """1 at bits that open and close at once."""
        return np.append((self.bits[:-1] == 1) & (self.bits[1:] == 0), False)


class LeastOf:
    """The least of any range of an array, from the least of ranges whose lengths are powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self._levels = [values]
        while len(self._levels[-1]) > (step := 1 << (len(self._levels) - 1)):
            last = self._levels[-1]
            self._levels.append(np.minimum(last[:-step], last[step:]))

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp((end - start).astype(float))[1] - 1
        out = np.empty(len(start), np.int64)
        for k in np.unique(level):
            mine = level == k
            out[mine] = np.minimum(self._levels[k][start[mine]], self._levels[k][end[mine] - (1 << int(k))])
        return out


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two strings of marks begin with together."""
    n = min(len(a), len(b))
    other = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return (int(other[0]) if len(other) else n) // MARK


NODES = ("shard int, name binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string")


def _shard(table: pa.Table) -> pa.Table:
    """Nodes of one shard; those that a neighbouring shard sees too come in part, and with a name."""
    kind = np.asarray(table.column("kind"))
    paths = table.column("path").to_pylist()
    before = next((p for k, p in zip(kind.tolist(), paths, strict=True) if k < 0), None)
    after = next((p for k, p in zip(kind.tolist(), paths, strict=True) if k > 0), None)
    own = sorted(np.flatnonzero(kind == 0).tolist(), key=paths.__getitem__)
    if not own:
        return pa.schema(_ARROW).empty_table()
    lists = {k: table.column(k).to_pylist() for k in ("words", "ends", "conv_id", "sha256")}

    # Preorder: where each string leaves the one before it, what it opens, and the bits.
    bits, parent, depth, words, above, total, ends, least, sha = [], [], [], [], [], [], [], [], []
    stack: list[int] = []
    last = b""
    for turn, i in enumerate(own):
        keep = common_turns(last, paths[i]) + 1 if turn else 0
        bits += [0] * (len(stack) - keep)
        del stack[keep:]
        per_turn = lists["words"][i]
        for d in range(keep, len(per_turn) + 1):
            bits.append(1)
            top = stack[-1] if stack else -1
            stack.append(len(parent))
            parent.append(top)
            depth.append(d)
            words.append(per_turn[d - 1] if d else 0)
            above.append(above[top] + words[top] if d else 0)
            total.append(0)
            ends.append(0)
            least.append(np.iinfo(np.int64).max)
            sha.append(None)
        node = stack[-1]
        ends[node], least[node], sha[node] = lists["ends"][i], lists["conv_id"][i], lists["sha256"][i]
        total[node] = lists["ends"][i] * (above[node] + words[node])
        last = paths[i]
    bits += [0] * len(stack)
    size, final_path = len(parent), list(stack)
    first_path = list(range(len(lists["words"][own[0]]) + 1))

    # Spines: open before this shard begins, or open when it ends.
    earlier = first_path[:common_turns(before, paths[own[0]]) + 1] if before is not None else []
    later = final_path[:common_turns(last, after) + 1] if after is not None else []
    opened = np.ones(size, bool)
    opened[earlier] = False
    shared = np.zeros(size, bool)
    shared[earlier] = shared[later] = True

    code = Parentheses(np.asarray(bits, np.uint8))
    opens = np.flatnonzero(code.bits)
    close = code.find_close(opens)
    upto = np.arange(size) + (close - opens + 1) // 2  # a subtree is a range of the preorder
    leaf = code.leaf_pairs()
    if len(later) == len(final_path):
        leaf[opens[final_path[-1]]] = False  # the next shard goes on below it
    rank = np.concatenate([[0], np.cumsum(leaf)])
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    words, above, parent, depth = (np.asarray(x, np.int64) for x in (words, above, parent, depth))
    each, all_words, once = sums(ends), sums(total), sums(words * opened)
    at = np.arange(size)
    convs = each[upto] - each[at]
    saved = all_words[upto] - all_words[at] - convs * above - (once[upto] - once[at])
    conv = LeastOf(np.asarray(least, np.int64)).range(at, upto)
    children = np.bincount(parent[opened & (parent >= 0)], minlength=size)

    names: list[bytes | None] = [None] * size
    for spine, path in ((earlier, paths[own[0]]), (later, last)):
        digest = hashlib.sha256()
        for d, node in enumerate(spine):
            digest.update(path[(d - 1) * MARK:d * MARK] if d else b"")
            names[node] = digest.digest()[:16] + d.to_bytes(8, "big")
    known = (parent >= 0) & ~shared[parent]
    return pa.table([
        pa.array(np.full(size, table.column("shard")[0].as_py(), np.int32)), pa.array(names, pa.binary()),
        pa.array([names[p] if p >= 0 else None for p in parent.tolist()], pa.binary()), pa.array(depth), pa.array(conv),
        pa.array(conv[parent], mask=~known), pa.array(convs), pa.array(children), pa.array(rank[close] - rank[opens]), pa.array(saved),
        pa.array(sha, pa.string())], schema=pa.schema(_ARROW))


_ARROW = [("shard", pa.int32()), ("name", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
          ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
          ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]


def trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of conversations: rows of ``ordered_turns`` or ``rebuilt``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (of the node's
    subtree), ends_sha256 (of the ascending ids of conversations that end here, joined by commas).
    """
    turns = stored(turns)
    shards = max(partitions(turns), -(-turns.count() // shard_turns))
    blocks = _strings(turns).groupBy("path", F.shiftright("conv_id", ID_BLOCK.bit_length() - 1).alias("block")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("words").alias("words"))
    texts = blocks.select("path", "block", "words", F.size("ids").alias("n"), F.col("ids")[0].alias("conv_id"),
                          F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    strings = stored(texts.repartitionByRange(shards, "path").sortWithinPartitions("path", "block").mapInArrow(
        _ends, "shard int, path binary, words array<int>, ends long, conv_id long, sha256 string"))

    # Every shard is told the last string before it and the first behind it: one row a shard is ordered for that.
    borders = strings.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("shard")
    told = borders.select("shard", F.array(
        F.struct(F.lit(-1).alias("kind"), F.lag("last").over(order).alias("path")),
        F.struct(F.lit(1).alias("kind"), F.lead("first").over(order).alias("path"))).alias("x"))
    told = told.select("shard", F.explode("x").alias("x")).select("shard", "x.*").where("path is not null")
    rows = strings.withColumn("kind", F.lit(0)).unionByName(told, allowMissingColumns=True)
    nodes = stored(rows.groupBy("shard").applyInArrow(_shard, NODES))

    parts = nodes.where("name is not null")
    spines = parts.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("ends_sha256").alias("ends_sha256"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    above = spines.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = spines.join(above, "parent", "left")
    # A node below a spine asks its own shard's row of it, so that the root answers once a shard.
    local = parts.select("shard", F.col("name").alias("parent")).join(above, "parent")
    inner = nodes.where("name is null").join(local.withColumnRenamed("parent_conv_id", "_told"), ["shard", "parent"], "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_told"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return inner.select(*names, sha).unionByName(whole.select(*names, sha))
