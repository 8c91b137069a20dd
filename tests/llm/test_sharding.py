"""The table against a plain turn-by-turn simulation, its balance, and placement."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riftscan.llm import sharding as sh


def plain(names, size):
    names, taken, turn = sorted(names), {}, 0
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    while len(taken) < size:
        name = names[turn % len(names)]
        offset, skip = h(f"{name}|offset") % size, h(f"{name}|skip") % (size - 1) + 1
        slot = next((offset + skip * j) % size for j in range(size) if (offset + skip * j) % size not in taken)
        taken[slot] = turn % len(names)
        turn += 1
    return [taken[s] for s in range(size)]


def test_turns():
    for names, size in ((["a", "b", "c"], 31), ([f"s{i}" for i in range(7)], 101), (["x"], 5)):
        assert sh.fill(names, size).tolist() == plain(names, size)
    counts = Counter(sh.fill([f"s{i}" for i in range(16)]).tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    with pytest.raises(ValueError):
        sh.fill(["a"], 10)
    with pytest.raises(ValueError):
        sh.fill([])


def test_few_slots_move():
    names = [f"s{i}" for i in range(16)]
    assert 1 / 16 <= sh.moved(names, names[:-1]) < 0.2
    assert sh.moved(names, names[::-1]) == 0


def test_placement(spark, tmp_path):
    docs = spark.createDataFrame([(None, "", 1), (5, None, 2), (5, "x" * 100_000, 3), (6, "y", 4)], "doc_id long, text string, slots int")
    names = ["a", "b", "c"]
    got = sh.place(docs, "doc_id", names, 31).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id == 5}) == 1
    assert all(r.shard == sh.fill(names, 31)[r.slot] and r.shard_name == names[r.shard] for r in got)
    assert sh.place(docs.limit(0), "doc_id", names, 31).count() == 0
    clash = docs.withColumnsRenamed({"slots": "shard", "text": "slot"})
    assert sorted((r.doc_id or 0, r.shard) for r in sh.place(clash, "doc_id", names, 31).collect()) == sorted((r.doc_id or 0, r.shard) for r in got)
    many = spark.range(1000).select(F.col("id").alias("doc_id"))
    sh.write(many, "doc_id", names, str(tmp_path / "out"), rows_per_task=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in back.select("doc_id", "shard").collect()} == {tuple(r) for r in sh.place(many, "doc_id", names).select("doc_id", "shard").collect()}
