"""Inter-arrival times of live captures, kept in Spark's state store."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed value: the state store that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
IDLE_SECONDS = 3600.0


def _set_aside(rows: Iterator[pd.DataFrame], held: IO[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number and time of all packets; the packets themselves wait in a file of the task, block by block."""
    numbers, times = [], []
    for packets in rows:
        numbers.append(packets["packet_no"].to_numpy(copy=True))
        times.append(packets["ts_us"].to_numpy(copy=True))
        pickle.dump(packets, held, pickle.HIGHEST_PROTOCOL)
    held.seek(0)
    return np.concatenate(numbers), np.concatenate(times)


def _returned(held: IO[bytes], gaps: np.ndarray, late: np.ndarray) -> Iterator[pd.DataFrame]:
    """The packets that were set aside, with their gaps."""
    at = 0
    while at < len(gaps):
        block = pickle.load(held)
        end = at + len(block)
        yield block.assign(gap_us=gaps[at:end], late=late[at:end])
        at = end


class GapState(StatefulProcessor):
    """Per capture the last packet: its number and time, how many packets came late, and when the capture is idle.

    A packet's gap is its time since the packet before it in the capture's order.  A packet whose number
    was already passed when its micro-batch came is late: it has gap 0, is marked and counted, and leaves the
    last packet as it is.  A capture without packets for ``idle_seconds`` (of processing time) is forgotten by a
    timer; its next packet is a first one.

    A task holds number and time of a capture's packets of one micro-batch; the other columns wait in a file of
    the task and come back block by block, so their order is that of their arrival.
    """

    def __init__(self, idle_seconds: float):
        self.idle = max(1, int(idle_seconds * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_no LONG, last_us LONG, n_late LONG, expires LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryFile() as held:
            numbers, times = _set_aside(rows, held)
            gaps, late = self._walked(numbers, times, timerValues)
            yield from _returned(held, gaps, late)

    def _walked(self, numbers: np.ndarray, times: np.ndarray, timerValues) -> tuple[np.ndarray, np.ndarray]:
        """Gap of each packet and whether it is late; the state moves on to the last packet."""
        now = timerValues.getCurrentProcessingTimeInMs()
        known = self.last.get() if self.last.exists() else None
        if known is not None:
            self.handle.deleteTimer(known[3])
            if known[3] <= now:
                known = None
        last_no, last_us, n_late = (known[0], known[1], known[2]) if known is not None else (None, None, 0)
        late = numbers <= last_no if last_no is not None else np.zeros(len(numbers), bool)
        order = np.argsort(numbers, kind="stable")
        order = order[~late[order]]
        gaps = np.zeros(len(numbers), np.int64)
        if len(order):
            timely = pd.Series(times[order])
            before = timely.shift(1, fill_value=0 if last_us is None else last_us)
            gaps[order] = (timely - before).where(before.notna() & (before != 0), 0).astype("int64")
            last_no, last_us = int(numbers[order[-1]]), int(timely.iloc[-1])
        expires = now + self.idle
        self.handle.registerTimer(expires)
        self.last.update((last_no, last_us, n_late + int(late.sum()), expires))
        return gaps, late

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        if known is not None and known[3] <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stateful_gaps(packets: DataFrame, idle_seconds: float = IDLE_SECONDS, capture: str = "capture_id") -> DataFrame:
    """A stream of packets (``packet_no``, ``ts_us`` and narrow columns without NULLs) with ``gap_us`` and ``late``.

    The state is one small row per live capture; frames should be decoded before, so that feature rows and
    not whole frames are shuffled.  The session needs :data:`STATE_STORE` when the query starts.
    """
    fields = [f for f in packets.schema.fields if f.name not in ("gap_us", "late")]
    schema = T.StructType([*fields, T.StructField("gap_us", T.LongType()), T.StructField("late", T.BooleanType())])
    return packets.groupBy(capture).transformWithStateInPandas(
        statefulProcessor=GapState(idle_seconds), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime"
    )
