"""Spelling variants: words that differ by one letter, grouped under the most frequent spelling.

Two words are near if one becomes the other by inserting, deleting or replacing exactly one code point. A word's form is
its near word of largest count (ties: smallest in code-point order) if that count is at least twice its own; its root is
where following forms ends.

Method (PartEnum). A word is a set of (letter, how many times so far): its multiset of letters as a binary vector. One
edit changes that vector in two places at most. The places are dealt to ``PARTS`` parts by a hash, so of two near words
at least ``PARTS`` - 2 parts are equal: a word has one signature for every choice of that many parts, and near words share
one exactly. Words are joined on signatures, and a shared signature is verified: bitmaps of letters and of letter pairs
bound the distance first, then the common start and end of both words decide. A pair counts only at the first
signature that it shares, so no pair is met twice and none needs to be written: a task returns for each of its words
how many near words it saw and the best of them.

Signatures that more than ``BLOCK`` words share are cut into blocks which meet pairwise in tasks of their own.

Defined results. Words come from whole texts (null: none); null ids are read as empty text where letters are deleted;
repeated rows count again. A word may be of any length. Other columns are ignored, and of columns that share a name the
first counts. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import columns_of, cuts, partitions, stored
from .text import give_back, mix

RUN = r"[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of a vector; two of them may differ.
PARTS = 6
CHOICES = list(itertools.combinations(range(PARTS), PARTS - 2))
#: Words of one signature that are compared in one task.
BLOCK = 4096
#: Signatures that a task holds on average, and pairs that it compares at once.
GROUP_ROWS = 250_000
PAIRS = 1 << 20
#: Words up to this length are verified side by side, longer ones one by one.
WIDE = 48


def words_with_slips(docs: DataFrame, one_in: int = 97) -> DataFrame:
    """(word) of every run of letters, lower-cased (A-Z), with a letter deleted where a checksum of id and run says so.

    The checksum is crc32 of ``<doc_id>:<run>``; where ``one_in`` divides it, code point (checksum % length) goes.
    """
    runs = columns_of(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.expr(f"regexp_extract_all(text, '{RUN}', 0)")).alias("x"))
    lower = runs.select("d", F.translate("x", UPPER, LOWER).alias("x"))
    summed = lower.select("x", F.crc32(F.concat("d", F.lit(":"), "x")).alias("h"))
    slip = F.expr(f"if(h % {one_in} = 0, concat(left(x, int(h % length(x))), substr(x, int(h % length(x)) + 2)), x)")
    return summed.select(slip.alias("word"))


def frequent(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of words that are long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Letters:
    """Code points of words, flat."""

    def __init__(self, words: list[str]) -> None:
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.word = np.repeat(np.arange(len(words)), self.length)

    def elements(self) -> tuple[np.ndarray, np.ndarray]:
        """Word and hash of every (letter, how many times so far)."""
        order = np.lexsort((self.points, self.word))
        point, word = self.points[order], self.word[order]
        edges = cuts(word * np.int64(0x110000) + point)
        times = np.arange(len(point)) - np.repeat(edges[:-1], np.diff(edges))
        return word, mix(point.astype(np.uint64) << np.uint64(32) | times.astype(np.uint64))

    def parts(self) -> np.ndarray:
        """A hash of each part of each word's vector."""
        word, element = self.elements()
        out = np.zeros((len(self.length), PARTS), np.uint64)
        np.bitwise_xor.at(out, (word, (element >> np.uint64(7)) % np.uint64(PARTS)), element)
        return out

    def bitmaps(self) -> tuple[np.ndarray, np.ndarray]:
        """64 bits of each word's letters and of its neighbouring letters: an edit flips few of them."""
        word, element = self.elements()
        one = np.zeros(len(self.length), np.uint64)
        np.bitwise_xor.at(one, word, np.uint64(1) << (element >> np.uint64(13)) % np.uint64(64))
        two = np.zeros(len(self.length), np.uint64)
        inside = self.word[1:] == self.word[:-1]
        pair = mix(self.points[:-1].astype(np.uint64) << np.uint64(32) | self.points[1:].astype(np.uint64))[inside]
        np.bitwise_xor.at(two, self.word[1:][inside], np.uint64(1) << pair % np.uint64(64))
        return one, two


def signatures(parts: np.ndarray) -> np.ndarray:
    """One signature for each choice of parts."""
    out = np.empty((len(parts), len(CHOICES)), np.uint64)
    for k, choice in enumerate(CHOICES):
        name = np.full(len(parts), k + 1, np.uint64)
        for part in choice:
            name = mix(name ^ parts[:, part])
        out[:, k] = name
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            few = batch.slice(at, 20_000)
            names = signatures(Letters(few.column(0).to_pylist()).parts())
            each = np.repeat(np.arange(few.num_rows), len(CHOICES))
            yield pa.RecordBatch.from_arrays([
                pa.array(names.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(len(CHOICES), dtype=np.int8), few.num_rows)),
                few.column(0).take(pa.array(each)), few.column(1).take(pa.array(each))], ["sig", "choice", "word", "n"])
        give_back()


def pairs_within(edges: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a < b, of all pairs within runs that begin at ``edges`` (and the end), about ``most`` at once."""
    rows = int(edges[-1])
    ahead = np.repeat(edges[1:], np.diff(edges)) - np.arange(rows) - 1
    upto = np.concatenate([[0], np.cumsum(ahead)])
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        mine = ahead[at:to]
        a = np.repeat(np.arange(at, to), mine)
        b = np.arange(upto[to] - upto[at]) - np.repeat(upto[at:to] - upto[at], mine) + a + 1
        if len(a):
            yield a, b
        at = to


def one_edit(words: list[str], letters: Letters, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b, not equal and of lengths at most one apart, are one edit apart.

    They are if the common start and the common end together leave no more than the edited code point.
    """
    near = np.zeros(len(a), bool)
    la, lb = letters.length[a], letters.length[b]
    wide = np.maximum(la, lb) > WIDE
    for k in np.flatnonzero(wide).tolist():
        x, y = sorted((words[a[k]], words[b[k]]), key=len)
        start = next((i for i, c in enumerate(x) if c != y[i]), len(x))
        near[k] = x[start + (len(x) == len(y)):] == y[start + 1:]
    for at in range(0, len(a), 50_000):
        some = np.flatnonzero(~wide[at:at + 50_000]) + at
        x, y = a[some], b[some]
        short = np.minimum(la[some], lb[some])
        column = np.arange(WIDE)
        inside = column < short[:, None]
        last = len(letters.points) - 1
        start = letters.points[np.minimum(letters.first[x][:, None] + column, last)] == letters.points[np.minimum(letters.first[y][:, None] + column, last)]
        end = letters.points[np.maximum(letters.first[x + 1][:, None] - 1 - column, 0)] == letters.points[np.maximum(letters.first[y + 1][:, None] - 1 - column, 0)]
        common = sum(np.where((ok := inside & same).all(1), WIDE, ok.argmin(1)).clip(max=short) for same in (start, end))
        near[some] = common >= short - (la[some] == lb[some])
    return near


def _met(table: pa.Table) -> pa.Table:
    """For each word of a group of signatures: how many near words it meets here for the first time, and the best."""
    order = np.lexsort((np.asarray(table["block"]), np.asarray(table["hi"]), np.asarray(table["lo"]), np.asarray(table["sig"])))
    table = table.take(pa.array(order))
    sig, lo, hi, block, choice = (np.asarray(table[c]) for c in ("sig", "lo", "hi", "block", "choice"))
    coded = table["word"].combine_chunks().dictionary_encode()
    words, code = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    count = np.zeros(len(words), np.int64)
    count[code] = np.asarray(table["n"])
    letters = Letters(words)
    one, two = letters.bitmaps()
    parts = letters.parts()
    fresh = (sig[1:] != sig[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    edges = np.concatenate([[0], np.flatnonzero(fresh) + 1, [len(sig)]])
    #: By the set of equal parts (bits): the first choice that it covers.
    first = np.array([next((k for k, c in enumerate(CHOICES) if all(m >> p & 1 for p in c)), -1) for m in range(1 << PARTS)])
    found = []
    for i, j in pairs_within(edges):
        a, b = code[i], code[j]
        ok = np.bitwise_count(two[a] ^ two[b]) <= 4
        i, a, b, j = i[ok], a[ok], b[ok], j[ok]
        ok = (np.bitwise_count(one[a] ^ one[b]) <= 2) & (abs(letters.length[a] - letters.length[b]) <= 1) & (
            (lo[i] == hi[i]) | (block[i] != block[j]))
        i, a, b = i[ok], a[ok], b[ok]
        equal = (parts[a] == parts[b]) @ (1 << np.arange(PARTS))
        ok = first[equal] == choice[i]
        a, b = a[ok], b[ok]
        ok = one_edit(words, letters, a, b)
        found.append(np.stack([a[ok], b[ok]]))
    a, b = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -count[b], a))
    a, b = a[order], b[order]
    head = cuts(a)
    best = b[head[:-1]]
    return pa.table({"word": pa.array([words[k] for k in a[head[:-1]].tolist()], pa.string()), "n_near": np.diff(head),
                     "best_n": count[best], "best": pa.array([words[k] for k in best.tolist()], pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """Of (word, n): (word, n_near, best, best_n) of words that have near words; the best has the largest n."""
    signed = words.mapInArrow(_signed, "sig long, choice byte, word string, n long")
    hot = stored(signed.groupBy("sig").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK).select(
        "sig", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks")))
    cut = signed.join(hot, "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = max(partitions(words), math.ceil(words.count() * len(CHOICES) / GROUP_ROWS))
    dealt = cut.select("sig", "choice", "word", "n", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("sig", "lo", "hi"), F.lit(groups)).cast("int"))
    met = dealt.groupBy("bucket").applyInArrow(_met, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """Of (word, form): (word, root), the end of each word's chain of forms. A chain must not come back to itself.

    Each round doubles how far a word has come, so there are as many rounds as the longest chain has binary digits.
    """
    far = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        step = far.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(far.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("_on")))
        far = moved.select("word", "root")
        if moved.where("_on").isEmpty():
            return far


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """Of (word, n): word, n, n_near, form, form_n, root."""
    words = stored(words)
    known = stored(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr(f"if(best_n >= {factor} * n, best, null)").alias("form"),
        F.expr(f"if(best_n >= {factor} * n, best_n, null)").alias("form_n")))
    ends = roots(known.where("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
