"""Streams against their batch forms, over several runs, with late records and ends of keys."""

import random
import time

from pyspark.sql import functions as F

from riftscan.operators import dedup as dd
from riftscan.operators.prefix import gap_sessions
from riftscan.streaming import ordered as so
from riftscan.streaming import runs as sn

SCHEMA = "k string, pos long, ident long"


def test_sessions_over_runs(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(3000), i) for i in range(400)]
    rows.sort(key=lambda r: r[1] + rng.randrange(60))  # nearly in order
    folder = sn.scratch(spark, "t")
    stream = lambda: so.stream_gap_sessions(
        spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), ["k"], "pos", "ident", 25, 7, 100)
    ended = [("a", None, None), ("b", None, None)]
    seen = []
    for part in (rows[:150], rows[150:300], rows[300:], ended, [("a", 5, 1000)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        seen.append(sn.drain(stream(), folder).count())
    got = {tuple(r) for r in sn.drain(stream(), folder).select("k", "pos", "ident", "sess", "chunk", "late").collect()}
    want = {(*r, False) for r in gap_sessions(spark.createDataFrame(rows, SCHEMA), ["k"], "pos", "ident", 25, 7).select("k", "pos", "ident", "sess", "chunk").collect()}
    assert got == want | {("a", 5, 1000, None, None, True)}
    assert 0 < seen[0] < seen[1] < seen[2] < seen[3] == 400 and seen[4] == 401


def test_late_records_change_nothing(spark):
    folder = sn.scratch(spark, "t")
    stream = lambda: so.stream_gap_sessions(
        spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), ["k"], "pos", "ident", 10, 100, 50)
    for part in ([("a", 0, 1), ("a", 200, 2)], [("a", 149, 3), ("a", 150, 4), ("a", 195, 5)], [("a", None, None)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = sn.drain(stream(), folder)
    assert sorted((r.ident, r.sess, r.late) for r in out.collect()) == [(1, 0, False), (2, 2, False), (3, None, True), (4, 1, False), (5, 2, False)]


def test_calls_and_progress(spark):
    rng = random.Random(3)
    schema = "cluster_id long, contig string, start long, end long, svtype string, svlen long, support long, prob double, partner_contig string"
    rows = []
    for i in range(300):
        start, n, kind = rng.randrange(20_000), rng.choice((60, 90, 300)), rng.choice(("DEL", "INS", "TRA"))
        rows.append((i, "c", start, start + n, kind, n, rng.randrange(1, 5), rng.choice((0.1, 0.5)), "d" if kind == "TRA" else None))
    rows.sort(key=lambda r: r[2])
    folder, told = sn.scratch(spark, "t"), []
    listener = sn.ProgressListener(told.append)
    spark.streams.addListener(listener)
    stream = lambda: so.stream_deduplicated_calls(spark.readStream.schema(schema).parquet(f"{folder}/in"), "cluster_id", 500)
    ends = [(None, "c", None, None, k, None, None, None, p) for k, p in (("DEL", None), ("INS", None), ("TRA", "d"))]
    for part in (rows[:120], rows[120:], ends):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = sn.drain(stream(), folder)
    want = dd.deduplicate_calls(spark.createDataFrame(rows, schema), ["cluster_id"])
    assert {r.ident for r in out.collect()} == {r.cluster_id for r in want.collect()} and out.where("late").isEmpty()
    for _ in range(50):
        if sum(r[2] for r in told) >= 303:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    frame = sn.progress_frame(spark, told)
    assert frame.agg(F.sum("rows")).first()[0] == 303 and frame.agg(F.max("state_rows")).first()[0] > 0
