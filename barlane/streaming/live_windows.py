"""Windows from a stream of bars (an extension: the batch sampler's windows, as their last row comes in).

Bars have an event time and may come in any order. A series' bars are held back until the stream's clock, the latest event time
seen in any series, is `wait` past them, and then go into windows in the order of their steps. What is held, and the last rows
in order, are list states: new rows are appended, and a list is written anew only when it has several windows' rows.

Late rows: a bar that comes when its series has gone on to a later step (or the same) is in no window. It is given back
as a row of kind `late`, so nothing is lost unseen, as long as the clock is less than `told` past it. Beyond that Spark's watermark leaves
it out and counts it (numRowsDroppedByWatermark).
Event times lie between `told` after 1970 and 2262. A bar without a series_id only moves the clock; so one of a far time closes a stream.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlane.functions.cluster import ship
from barlane.sources.schemas import INPUT_LEN, WINDOW

OUTPUT = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("series_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("last_input", T.DoubleType()),
    T.StructField("last_target", T.DoubleType()),
    T.StructField("time_step", T.LongType()),
    T.StructField("close", T.DoubleType()),
])
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAIT, TOLD = timedelta(minutes=10), timedelta(days=1)
#: Windows' rows that the list of rows in order may have.
SLACK = 4

# Spark starts a worker on the driver for the processor, which has neither the driver's import path nor shipped files: so the class itself is sent.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class LiveWindows(StatefulProcessor):
    """One series' state: `held` bars (step, time, close), `ordered` closes that coming windows need, the last step and position."""

    def __init__(self, window: int, input_len: int, wait_ms: int, told_ms: int) -> None:
        self.window, self.input_len, self.ahead = window, input_len, told_ms - wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "step long, at long, close double")
        self.ordered = handle.getListState("ordered", "close double")
        self.place = handle.getValueState("place", "next long, step long, kept int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        place = self.place.get() if self.place.exists() else None
        last, first = place[1] if place else None, None
        for frame in rows:
            frame = frame[frame["clock"] == 0]
            if last is not None:
                late = frame[frame["time_step"] <= last]
                if len(late):
                    yield pd.DataFrame({"kind": "late", "series_id": key[0], "start": None, "last_input": None, "last_target": None, "time_step": late["time_step"], "close": late["close"]})
                frame = frame[frame["time_step"] > last]
            if len(frame):
                at = frame["at"].tolist()
                self.held.appendList(list(zip(frame["time_step"].tolist(), at, frame["close"].tolist(), strict=True)))
                first = min(at) if first is None else min(first, *at)
        if first is not None:
            self.handle.registerTimer(self._due(first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All held bars that are due go into windows; a timer for the first of the others is set."""
        clock = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.held.get()) if self.held.exists() else []
        n = 0
        while n < len(held) and self._due(held[n][1]) <= clock:
            n += 1
        due, rest = held[:n], held[n:]
        if not due:
            return
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(self._due(min(at for _, at, _ in rest)))
        else:
            self.held.clear()
        place = self.place.get() if self.place.exists() else (0, None, 0)
        before = np.array([x[0] for x in self.ordered.get()] if place[2] else [], float)
        new = np.array([c for *_, c in due], float)
        close = np.append(before, new)
        position, keep = place[0] + len(new), min(len(close), self.window - 1)
        if len(close) <= SLACK * self.window:
            self.ordered.appendList([(c,) for c in new.tolist()])
            kept = len(close)
        else:
            self.ordered.put([(c,) for c in close[len(close) - keep :].tolist()])
            kept = keep
        self.place.update((position, due[-1][0], kept))
        # Windows that end at a new row.
        ends = np.arange(max(self.window - 1, len(before)), len(close))
        if len(ends):
            starts = position - len(close) + ends - self.window + 1
            yield pd.DataFrame({"kind": "window", "series_id": key[0], "start": starts, "last_input": close[ends - self.window + self.input_len], "last_target": close[ends], "time_step": None, "close": None})

    def _due(self, at: int) -> int:
        """The watermark at which the clock is `wait` past a bar's time: the watermark is `told` behind the clock."""
        return max(1, at - self.ahead)


def live_windows(bars: DataFrame, wait: timedelta = WAIT, told: timedelta = TOLD, window: int = WINDOW, input_len: int = INPUT_LEN) -> DataFrame:
    """Windows and late rows of streaming `bars` (series_id, time_step, close, event_time), told apart by `kind`: a window has series_id, start and its
    last_input and last_target close, a late row series_id, time_step and close.

    `wait` is how long bars are waited for, `told` (no less) how late ones may be and still be told. The order inside a series is
    that of the steps, so a series' event times should rise with them; equal steps that are there in time are ordered by time and
    close, as rows of their own. A null close is kept as a row without a price. The session's state store is set to RocksDB.
    """
    spark = bars.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    wait_ms, told_ms = (span // timedelta(milliseconds=1) for span in (wait, told))
    if told_ms < wait_ms:
        raise ValueError("late rows can't be told for less time than they are waited for")
    # A null among whole numbers would make floats of all of them in its pandas batch, and null keys of those; so none is sent.
    no_series = F.col("series_id").isNull()
    number = lambda c: F.when(no_series, 0).otherwise(F.col(c).cast("long"))
    rows = bars.withWatermark("event_time", f"{told_ms} milliseconds").select(number("series_id").alias("series_id"), no_series.cast("long").alias("clock"), number("time_step").alias("time_step"), F.col("close").cast("double").alias("close"), F.unix_millis("event_time").alias("at"), "event_time")
    return rows.groupBy("series_id", "clock").transformWithStateInPandas(LiveWindows(window, input_len, wait_ms, told_ms), OUTPUT, "append", "EventTime")
