"""Runs of streams to their end, and their progress as rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "run string, batch long, rows long, state_rows long, millis long"


class ProgressListener(StreamingQueryListener):
    """Tells every finished micro-batch of the streams of a session to ``sink`` (run, batch, rows, state_rows, millis)."""

    def __init__(self, sink: Callable[[tuple], None]) -> None:
        self._sink = sink

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        state = sum(int(s.numRowsTotal) for s in p.stateOperators)
        self._sink((str(p.runId), int(p.batchId), int(p.numInputRows), state, int(p.durationMs.get("triggerExecution", 0))))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(streamed: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that its sources have now, into Parquet under ``folder``; what the sink holds then.

    State and offsets stay in ``folder``: called again with a stream of the same plan, it goes on where it ended.
    """
    spark = streamed.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = streamed.writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(streamed.schema).parquet(f"{folder}/rows")


def drain_to_end(rows: DataFrame, ends: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Drain ``build`` of the stream ``rows``, then tell it the ends of its keys (``ends``: rows with a null position).

    The ends come through a source folder of their own in a second run that goes on from the first one's state.
    """
    spark = rows.sparkSession
    path = f"{folder}/ends"
    spark.createDataFrame([], rows.schema).write.parquet(path)
    streamed = build(rows.unionByName(spark.readStream.schema(rows.schema).parquet(path)))
    drain(streamed, folder)
    ends.select(*rows.columns).write.mode("append").parquet(path)
    return drain(streamed, folder)


def progress_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PROGRESS)
