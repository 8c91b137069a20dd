"""Ordered operators on streams: gap sessions and call deduplication as records arrive.

Both walk the records of a key in the order of their position, so a record waits until nothing before it can come any
more. A key's horizon is its largest position so far less ``lateness``; what lies below the horizon is walked in order
and leaves the state, so a key keeps only records within ``lateness`` and the walk's own few numbers. A record that
comes behind the horizon is late: it changes nothing any more and is told with ``late`` true. A record whose position is
null ends its key: the horizon moves behind everything, and later records of the key are late. So a stream that is told
the ends of its keys has the result of the batch operator.
"""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import ACTIVE_WINDOW, Places

_END = 1 << 62


class _Walk(StatefulProcessor):
    """Keeps a key's waiting records and hands those below the horizon to ``walk`` in order."""

    #: Schema and columns of a waiting record; the first is the position.
    waiting: str
    columns: list[str]
    #: Schema of the walk's own numbers, and their first values.
    numbers: str
    start: tuple

    def __init__(self, keys: list[str], lateness: int) -> None:
        self._keys, self._lateness = keys, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._pending = handle.getListState("pending", self.waiting)
        self._numbers = handle.getValueState("numbers", f"highest long, horizon long, {self.numbers}")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Other state of the walk."""

    @abstractmethod
    def walk(self, key: tuple, rows: list[tuple], numbers: tuple, ended: bool) -> tuple[list[tuple], tuple]:
        """Answers for rows in order, and the numbers behind them."""

    @abstractmethod
    def late(self, row: tuple) -> tuple:
        """The answer for a late record."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        highest, horizon, *numbers = self._numbers.get() if self._numbers.exists() else (-_END, -_END, *self.start)
        fresh, ended = [], False
        for frame in rows:
            ended |= bool(frame["ended"].any())
            fresh += list(frame.loc[~frame["ended"], self.columns].itertuples(index=False, name=None))
        out = [self.late(r) for r in fresh if r[0] < horizon]
        fresh = [r for r in fresh if r[0] >= horizon]
        highest = max([highest, *(r[0] for r in fresh)])
        new_horizon = _END if ended else max(horizon, highest - self._lateness)
        pending = [tuple(r) for r in self._pending.get()] if self._pending.exists() else []
        ready = sorted((r for r in pending + fresh if r[0] < new_horizon), key=self.order)
        left = [r for r in pending + fresh if r[0] >= new_horizon]
        answers, numbers = self.walk(key, ready, tuple(numbers), ended)
        self._pending.put(left) if left else self._pending.clear()
        self._numbers.update((highest, new_horizon, *numbers))
        out += answers
        if out:
            frame = pd.DataFrame(out, columns=self.answers)
            for i, name in enumerate(self._keys):
                frame.insert(i, name, key[i])
            yield frame

    @staticmethod
    def order(row: tuple) -> tuple:
        return row

    def close(self) -> None:
        pass


class _Sessions(_Walk):
    waiting, columns = "pos long, ident long", ["pos", "ident"]
    numbers, start = "last long, sess long, rows long", (-_END, -1, 0)
    answers = ["pos", "ident", "sess", "chunk", "late"]

    def __init__(self, keys: list[str], lateness: int, max_gap: int, max_size: int) -> None:
        super().__init__(keys, lateness)
        self._gap, self._size = max_gap, max_size

    def walk(self, key, rows, numbers, ended):
        (last, sess, count), out = numbers, []
        for pos, ident in rows:
            if sess < 0 or pos - last > self._gap:
                sess, count = sess + 1, 0
            out.append((pos, ident, sess, count // self._size, False))
            last, count = pos, count + 1
        return out, (last, sess, count)

    def late(self, row):
        return (*row, None, None, True)


class _Calls(_Walk):
    waiting = "start long, end long, len long, support long, prob double, ident long"
    columns = ["start", "end", "len", "support", "prob", "ident"]
    numbers, start = "walked long", (0,)
    answers = ["start", "end", "len", "support", "prob", "ident", "late"]

    def open(self, handle):
        self._places = handle.getListState("places", self.waiting)

    @staticmethod
    def order(row):
        start, end, length, support, prob, ident = row
        return start, end, length, -support, -prob, ident

    def walk(self, key, rows, numbers, ended):
        """Calls that left the window for good; at a key's end the open ones too."""
        state = Places(key[1], [tuple(r) for r in self._places.get()] if self._places.exists() else [])
        gone = []
        for row in rows:
            gone += state.close_before(row[0])
            state.take(row)
        if ended:
            gone, state.calls = gone + state.calls, []
        self._places.put(state.calls) if state.calls else self._places.clear()
        return [(*c, False) for c in gone], (numbers[0] + len(rows),)

    def late(self, row):
        return (*row, True)


def _filled(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Rows without nulls: ``ended`` says that the position was one."""
    return rows.select(*keys, F.col(pos).isNull().alias("ended"), *(F.coalesce(c, F.lit(0)).alias(c) for c in rows.columns if c not in keys))


def _types(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def stream_gap_sessions(df: DataFrame, keys: list[str], pos: str, ident: str, max_gap: int, max_size: int, lateness: int) -> DataFrame:
    """Streaming form of ``gap_sessions``: keys, pos, ident, sess, chunk, late, one row for each record once its place is settled.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). Append mode.
    """
    rows = df.select(*keys, F.col(pos).cast("long").alias("pos"), F.col(ident).cast("long").alias("ident"))
    schema = f"{_types(df, keys)}, pos long, ident long, sess long, chunk long, late boolean"
    return _filled(rows, keys, "pos").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Sessions(keys, lateness, max_gap, max_size), outputStructType=schema, outputMode="Append", timeMode="None")


def stream_deduplicated_calls(calls: DataFrame, ident: str, lateness: int = ACTIVE_WINDOW) -> DataFrame:
    """Streaming form of ``deduplicate_calls``: contig, svtype, partner_key, start, end, len, support, prob, ident, late.

    A call comes out when its place has left the window, in the form that the strongest of its place has; a call that
    merged into another doesn't. ``ident`` settles ties, so calls of one geometry and strength keep the smallest id.
    """
    keys = ["contig", "svtype", "partner_key"]
    length = F.when(F.col("svtype") == "TRA", F.lit(0)).otherwise(F.greatest(F.lit(1), F.abs("svlen")))
    rows = calls.select("contig", "svtype", F.coalesce("partner_contig", F.lit("")).alias("partner_key"), F.col("start").cast("long").alias("start"),
                        F.col("end").cast("long").alias("end"), length.cast("long").alias("len"), F.col("support").cast("long").alias("support"),
                        F.col("prob").cast("double").alias("prob"), F.col(ident).cast("long").alias("ident"))
    return _filled(rows, keys, "start").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Calls(keys, lateness), outputMode="Append", timeMode="None",
        outputStructType="contig string, svtype string, partner_key string, start long, end long, len long, support long, prob double, ident long, late boolean")
