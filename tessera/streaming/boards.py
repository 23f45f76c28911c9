"""The source states of ``operators.lifecycle`` kept by a stream, with a timer for each source's next poll."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.lifecycle import DEAD_INTERVAL, FAILURES, INTERVALS, LONGEST, OTHER_INTERVAL, START, step

STATE = T.StructType(
    [T.StructField("status", T.StringType()), T.StructField("tier", T.StringType()), T.StructField("failures", T.IntegerType()), T.StructField("not_found", T.IntegerType()), T.StructField("empty_since", T.TimestampType()), T.StructField("polls", T.LongType())]
)
OUTPUT = T.StructType([T.StructField("source", T.StringType()), T.StructField("event", T.StringType()), T.StructField("at", T.TimestampType()), *STATE.fields, T.StructField("next_seconds", T.LongType())])


def seconds_to_next(state: dict) -> int:
    """Seconds until a source's next poll, as ``next_interval`` has them."""
    return DEAD_INTERVAL if state["status"] == "dead" else LONGEST if state["failures"] >= FAILURES else INTERVALS.get(state["tier"], OTHER_INTERVAL)


class Boards(StatefulProcessor):
    """One row ``polled`` for each source of a batch with its state after it, and one row ``due`` when its next poll is due.

    A batch's polls are taken in the order of their time; those of an earlier time than what was seen before are taken as they come.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def _row(self, source: str, event: str, at, state: dict) -> pd.DataFrame:
        return pd.DataFrame({"source": [source], "event": [event], "at": [at], **{k: [v] for k, v in state.items()}, "next_seconds": [seconds_to_next(state)]}).astype({"empty_since": "datetime64[ns]", "at": "datetime64[ns]"})

    def _held(self) -> dict:
        if not self.state.exists():
            return {**START, "polls": 0}
        held = dict(zip(STATE.names, self.state.get()))
        return held | {"empty_since": None if held["empty_since"] is None or pd.isna(held["empty_since"]) else pd.Timestamp(held["empty_since"]).to_pydatetime().replace(tzinfo=None)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, at = self._held(), None
        for p in pd.concat(list(rows)).sort_values(["at", "poll"]).itertuples():
            at = p.at.to_pydatetime().replace(tzinfo=None)
            polls = state.pop("polls")
            state = step(state, bool(p.ok), None if pd.isna(p.code) else int(p.code), None if pd.isna(p.found) else int(p.found), at) | {"polls": polls + 1}
        self.state.update(tuple(state[n] for n in STATE.names))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((pd.Timestamp(at, tz="UTC") + timedelta(seconds=seconds_to_next(state))).timestamp() * 1000))
        yield self._row(key[0], "polled", at, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._held()
        yield self._row(key[0], "due", pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), state)

    def close(self) -> None:
        pass


def board_states(polls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The stream of states and due polls of a stream of polls (source, at, poll, ok, code, found).

    The session must use the RocksDB state store and UTC.
    """
    timed = polls.withColumn("at", polls["at"].cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("source").transformWithStateInPandas(Boards(), OUTPUT, "Append", "EventTime")
