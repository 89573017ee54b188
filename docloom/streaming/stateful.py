"""Streams with state of their own: rate limits in event time, sessions; both end equal to their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom.streaming.limits import admitted

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(stream: DataFrame) -> None:
    provider = stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if not provider.endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKSDB}")


class _Limiter(StatefulProcessor):
    """Requests wait until the watermark has passed their slot; then they are judged in order of time."""

    def __init__(self, window_seconds: float, most: int):
        self.window, self.most = window_seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at timestamp, id long")
        self.log = handle.getListState("log", "at double")

    def _slot_end(self, at: pd.Timestamp) -> int:
        slot = max(1, int(self.window * 1000))
        return (int(at.timestamp() * 1000) // slot + 1) * slot

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendList([(at.to_pydatetime(), int(i)) for at, i in zip(part["at"], part["id"])])
            for end in {self._slot_end(at) for at in part["at"]}:
                self.handle.registerTimer(end)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted((pd.Timestamp(at), i) for at, i in self.waiting.get())
        due = [r for r in rows if r[0].timestamp() * 1000 < end]
        rest = [r for r in rows if r[0].timestamp() * 1000 >= end]
        ok, log = admitted([at.timestamp() for at, _ in due], [x[0] for x in self.log.get()], self.window, self.most)
        # What no later request can see any more is forgotten.
        log = [x for x in log if end / 1000 - x < self.window]
        for state, values in ((self.waiting, [(at.to_pydatetime(), i) for at, i in rest]), (self.log, [(x,) for x in log])):
            if values:
                state.put(values)
            else:
                state.clear()
        if not rest and log:  # the log's own end: nothing of the key is kept then
            self.handle.registerTimer(end + int(self.window * 1000) + 1)
        if due:
            yield pd.DataFrame({"key": [key[0]] * len(due), "at": [at for at, _ in due], "id": [i for _, i in due], "admitted": ok})

    def close(self) -> None:
        pass


def limited(requests: DataFrame, window_seconds: float, most: int, late: str) -> DataFrame:
    """Stream of key, at, id, admitted for requests (key, at, id): at most `most` admitted ones of a key in any window.

    Requests may come in any order within `late`; each is judged when the
    watermark has passed its slot (a window's length), so the answers are those of
    `limits.limited_batch` over the whole log. Waiting requests and admitted times
    are list states of the key: a batch appends to the first, and only the slots
    whose timers fire are read. The log of a quiet key goes by a timer too.
    """
    _ready(requests)
    rows = requests.withWatermark("at", late).select("key", "at", "id")
    return rows.groupBy("key").transformWithStateInPandas(_Limiter(window_seconds, most), "key string, at timestamp, id long, admitted boolean", "append", "EventTime")


class _Sessions(StatefulProcessor):
    def __init__(self, idle_seconds: float):
        self.idle = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "turn_count long, first_turn long, mode string, created_at timestamp, last_active_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            first = part.sort_values("turn").iloc[0]
            own = (int(part["turn"].max()), int(first["turn"]), first["mode"], part["at"].min().to_pydatetime(), part["at"].max().to_pydatetime())
            if self.session.exists():
                old = self.session.get()
                own = (max(old[0], own[0]), *(old[1:3] if old[1] <= own[1] else own[1:3]), min(old[3], own[3]), max(old[4], own[4]))
            self.session.update(own)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        now = self.session.get()
        self.handle.registerTimer(int((pd.Timestamp(now[4]).timestamp() + self.idle) * 1000) + 1)
        yield self._row(key, now, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.session.get()
        self.session.clear()
        yield self._row(key, now, False)

    @staticmethod
    def _row(key, session: tuple, active: bool) -> pd.DataFrame:
        turn_count, _, mode, created, last = session
        return pd.DataFrame({"session_id": [key[0]], "turn_count": [turn_count], "mode": [mode], "created_at": [created], "last_active_at": [last], "active": [active]})

    def close(self) -> None:
        pass


def sessions(turns: DataFrame, idle_seconds: float, late: str) -> DataFrame:
    """Stream of session_id, turn_count, mode, created_at, last_active_at, active for turns (session_id, turn, mode, at).

    A row whenever a session changes: the greatest turn, the mode of the least one,
    the first and the last time, whatever the order of arrival within `late`; the last
    row of a session is what `store.sessions` gives for all its turns. A session
    that was idle for `idle_seconds` of event time is told as not active and
    forgotten; a turn after that opens a new one.
    """
    _ready(turns)
    rows = turns.withWatermark("at", late).select("session_id", "turn", "mode", "at")
    return rows.groupBy("session_id").transformWithStateInPandas(_Sessions(idle_seconds), "session_id string, turn_count long, mode string, created_at timestamp, last_active_at timestamp, active boolean", "update", "EventTime")
