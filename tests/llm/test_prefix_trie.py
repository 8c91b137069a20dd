"""The trie against plain dictionaries, with few and many shards; parentheses against a stack."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from riftscan.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
BORROWED = "crc32(string(conv_id)) % 4"


def plain(rows, rebuild):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    convs = own
    if rebuild:
        convs = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            convs[c] = own.get(c - c % 20, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                 sum(len(p) == len(path) + 1 for p in below), sum(not any(q[:-1] == p for q in nodes if q) for p in below),
                 sum((len(nodes[p]) - 1) * words(p) for p in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in df.select(names).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(seed, convs=70):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        c = c * rng.choice((1, 1, 20))
        for t in range(rng.choice((0, 1, 1, 2, 3, 6, 30))):
            rows.append((c, rng.choice((t, t, None)), rng.choice(("u", "u", None)), rng.choice(("a b", "a b", "c\td", "", None))))
    return [*rows, (None, 1, "u", "x"), (5, 0, "u", "x y z"), (5, 0, "u", "x y z"), (7, 1, "u", "w " * 50_000)]


def test_against_dictionaries(spark):
    for seed, shard_turns in ((1, 10**6), (2, 25), (3, 5)):
        rows = random_rows(seed)
        turns = pt.ordered_turns(spark.createDataFrame(rows, SCHEMA))
        assert rows_of(pt.trie(turns, shard_turns)) == plain(rows, False)
        assert rows_of(pt.trie(pt.rebuilt(turns, 20, BORROWED), shard_turns)) == plain(rows, True)


def test_copies_and_a_common_start(spark):
    """A third of all conversations are one, all share a first turn; negative ids; a column of another name twice."""
    rows = [(c - 30, t, "u", "hello there" if t == 0 or c % 3 == 0 else f"{c} {t}") for c in range(90) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("a.b", F.lit(1)).withColumn("x", F.lit(1))
    df = df.toDF("conv_id", "turn", "role", "text", "a.b", "text")
    assert rows_of(pt.trie(pt.ordered_turns(df), 17)) == plain(rows, False)


def test_empty(spark):
    assert pt.trie(pt.ordered_turns(spark.createDataFrame([], SCHEMA))).count() == 0
    none = spark.createDataFrame([(None, 0, "u", "x")], SCHEMA)
    assert pt.trie(pt.rebuilt(pt.ordered_turns(none), 20, BORROWED)).count() == 0


def test_parentheses():
    rng = random.Random(4)
    for n in (1, 31, 32, 33, 500, 3000):
        bits, open_ = [], 0
        left = n
        while left or open_:
            if left and (not open_ or rng.random() < 0.5 + 0.3 * (n % 2)):
                bits.append(1)
                left, open_ = left - 1, open_ + 1
            else:
                bits.append(0)
                open_ -= 1
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        code = pt.Parentheses(np.array(bits, np.uint8))
        opens = np.flatnonzero(code.bits)
        assert code.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
    values = np.array([rng.randrange(50) for _ in range(100)])
    start = np.array([0, 5, 99, 3]), np.array([100, 6, 100, 40])
    assert pt.LeastOf(values).range(*start).tolist() == [values[a:b].min() for a, b in zip(*start, strict=True)]
