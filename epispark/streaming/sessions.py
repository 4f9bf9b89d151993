"""Episodes of a stream that end by silence, and the state of a finished or running job as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from epispark.streaming.trigger import use_rocksdb


class SilenceProcessor(StatefulProcessor):
    """One row per closed episode: ``first_ms, last_ms, n``.

    State is three numbers and one event-time timer per open episode. A row that comes more than
    ``idle_ms`` after the one before it opens a new episode; a timer closes an episode as soon as the
    watermark is ``idle_ms`` past its last row, and frees its state.
    """

    def __init__(self, key: str, idle_ms: int):
        self.key, self.idle = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        numbers = [T.StructField(n, T.LongType()) for n in ("first", "last", "n")]
        self.open = handle.getValueState("open", T.StructType(numbers))

    def _rows(self, key, closed: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *c) for c in closed], columns=[self.key, "first_ms", "last_ms", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(x) for pdf in rows for x in pdf["silence_ms"])
        state = tuple(self.open.get()) if self.open.exists() else None
        if state:
            self.handle.deleteTimer(state[1] + self.idle)
        closed = []
        for ms in times:
            if state and ms - state[1] > self.idle:
                closed.append(state)
                state = None
            state = (min(state[0], ms), max(state[1], ms), state[2] + 1) if state else (ms, ms, 1)
        self.open.update(state)
        self.handle.registerTimer(state[1] + self.idle)
        yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = []
        if self.open.exists():
            state = tuple(self.open.get())
            if state[1] + self.idle <= expiredTimerInfo.getExpiryTimeInMs():
                closed.append(state)
                self.open.clear()
        yield self._rows(key, closed)

    def close(self) -> None:
        pass


def close_silent(stream: DataFrame, key: str, time: str, idle_ms: int, delay: str) -> DataFrame:
    """``key, first_ms, last_ms, n`` of every episode that ended by ``idle_ms`` of silence.

    Rows later than ``delay`` behind the newest one are dropped by the watermark; an episode that is still
    open when the stream stops has no row yet, its state waits in the checkpoint.
    """
    use_rocksdb(stream)
    rows = stream.withWatermark(time, delay).select(key, time, F.floor(F.unix_micros(time) / 1000).alias("silence_ms"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=SilenceProcessor(key, idle_ms),
        outputStructType=T.StructType.fromDDL(f"{key} {kind}, first_ms long, last_ms long, n long"),
        outputMode="Append",
        timeMode="EventTime",
    )


def read_history(spark: SparkSession, checkpoint: str, variable: str = "history") -> DataFrame:
    """``episode, history``: the list state of a trigger job, oldest entry first, from its checkpoint.

    The state is read as of the last committed micro-batch, without running the job.
    """
    state = (
        spark.read.format("statestore").option("stateVarName", variable)
        .option("flattenCollectionTypes", "false").load(checkpoint)
    )
    value = F.transform("list_value", lambda x: x["v"])
    return state.select(F.col("key")["episode"].alias("episode"), value.alias("history"))
