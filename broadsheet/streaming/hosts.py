"""What is remembered of hosts while a stream of tries goes by: their refusals and when they were asked last.

State is kept by host and day, and ends with its day: a timer at the end of the day removes it once the watermark has
passed, so it holds as many hosts as two days have, however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import ship

#: Transformations with state need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _day_end(day: date) -> int:
    """Milliseconds since 1970 at the end of a day (UTC)."""
    return int((datetime(day.year, day.month, day.day, tzinfo=timezone.utc) + timedelta(days=1)).timestamp() * 1000)


class DayState(StatefulProcessor):
    """One value of state per key whose last field is a day; subclasses say how rows, in order, change it."""

    STATE = ""
    FIRST: tuple = ()
    ORDER: list[str] = []
    NAMES: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType.fromDDL(self.STATE) if isinstance(self.STATE, str) else self.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.state.exists():
            held = tuple(self.state.get())
        else:
            held = self.FIRST
            self.handle.registerTimer(_day_end(key[-1]))
        # A host is asked once a second at most, so a key has at most a day's seconds of rows; only these columns stay.
        own = pd.concat([frame[self.NAMES] for frame in rows]).sort_values(self.ORDER, kind="stable")
        held, out = self.step(held, own)
        self.state.update(held)
        yield out.assign(**dict(zip(self.KEY, key, strict=True)))[[*self.KEY, *out.columns]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class Refusals(DayState):
    """Tries after a host refused an agent `most` times since that one's last success that day are retired."""

    KEY, ORDER, NAMES, FIRST = ["host", "agent", "day"], ["event_id"], ["event_id", "refused", "succeeded"], (0, False)

    def __init__(self, state: StructType, most: int) -> None:
        self.STATE, self.most = state, most

    def step(self, held: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        streak, tripped = held
        retired = []
        for refused, succeeded in zip(rows["refused"], rows["succeeded"], strict=True):
            retired.append(bool(tripped))
            streak = 0 if succeeded else streak + int(refused)
            tripped = tripped or streak >= self.most
        return (int(streak), bool(tripped)), pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "retired": retired})


class Pacing(DayState):
    """Each try starts when it is asked for, and `gap_s` after the start before it at the earliest."""

    KEY, ORDER, NAMES, FIRST = ["host", "day"], ["asked_at", "event_id"], ["event_id", "asked_at"], (float("-inf"),)

    def __init__(self, state: StructType, gap_s: float) -> None:
        self.STATE, self.gap_s = state, gap_s

    def step(self, held: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (last,) = held
        starts = []
        for asked in rows["asked_at"]:
            last = max(float(asked), last + self.gap_s)
            starts.append(last)
        return (last,), pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "start_at": starts})


def _by_day(tries: DataFrame, processor: DayState, out: str, lateness: str) -> DataFrame:
    ship(tries.sparkSession)
    if tries.sparkSession.conf.get(STORE[0], "") != STORE[1]:
        tries.sparkSession.conf.set(*STORE)
    rows = tries.select(*processor.KEY, *processor.NAMES, F.col("day").cast("timestamp").alias("at")).withWatermark("at", lateness)
    return rows.groupBy(*processor.KEY).transformWithStateInPandas(processor, out, "append", "EventTime")


def refusal_stream(tries: DataFrame, most: int = 3, lateness: str = "1 day") -> DataFrame:
    """host, agent, day, event_id, retired for tries (host, agent, day, event_id, refused, succeeded): the verdicts of
    operators.state.host_refusals, with two numbers of state for each host, agent and day.  Tries of a day that ended
    more than `lateness` ago are dropped, as any late event is."""
    return _by_day(tries, Refusals(StructType.fromDDL("streak int, tripped boolean"), most), "host string, agent string, day date, event_id long, retired boolean", lateness)


def pace_stream(tries: DataFrame, gap_s: float = 1.0, lateness: str = "1 day") -> DataFrame:
    """host, day, event_id, start_at for tries (host, day, event_id, asked_at in seconds) that come in the order asked:
    starts at one host lie gap_s apart, as operators.state.paced has them."""
    return _by_day(tries, Pacing(StructType.fromDDL("last double"), gap_s), "host string, day date, event_id long, start_at double", lateness)
