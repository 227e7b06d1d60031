"""Movement throttle with a second input: fixes, and changes of the settings and the site count.

Rows are events ``(session_id, event_id, ts, kind, lat, lon, alt_m, clearance_m, margin_m, sites)`` of
kind ``fix`` (with a position) or ``settings`` (with what changes, null: stays). A session's events count
in the order of ``(ts, event_id)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from glidemesh.streaming.throttle import _moved

COLUMNS = ["session_id", "event_id", "ts", "kind", "lat", "lon", "alt_m", "clearance_m", "margin_m", "sites"]
OUT = "session_id long, event_id long, why string"
STATE = "lat double, lon double, alt_m double, clearance_m double, margin_m double, sites double, at_lat double, at_lon double, at_alt double, was_clearance double, was_margin double, was_sites double, seen double"


@dataclass(frozen=True)
class ThrottleParams:
    move_m: float = 400.0
    climb_m: float = 75.0
    #: Without an event for so long a session is forgotten.
    idle_s: float = 3_600.0


class Session:
    """Where a session is, what holds for it, and both as they were when it last emitted."""

    def __init__(self, values: tuple | None = None):
        x = tuple(values) if values is not None else (None,) * 13
        self.here, self.inputs, self.last, self.were, self.seen = x[0:3], x[3:6], x[6:9], x[9:12], x[12]

    def values(self) -> tuple:
        return (*self.here, *self.inputs, *self.last, *self.were, self.seen)

    def step(self, ts: float, kind: str, at: tuple, inputs: tuple, p: ThrottleParams) -> str | None:
        """Take an event; why it is emitted, or None."""
        if self.seen is not None and ts - self.seen > p.idle_s:
            self.__init__()
        self.seen = ts
        if kind == "settings":
            self.inputs = tuple(old if new is None else float(new) for old, new in zip(self.inputs, inputs))
        elif None in at:
            return None
        else:
            self.here = tuple(map(float, at))
        if self.here[0] is None:
            return None
        if self.last[0] is None:
            why = "first"
        elif self.inputs != self.were:
            why = "settings"
        elif _moved(self.last, self.here, p.move_m, p.climb_m):
            why = "moved"
        else:
            return None
        self.last, self.were = self.here, self.inputs
        return why


def _events(pdf: pd.DataFrame) -> Iterator[tuple]:
    known = lambda v: None if pd.isna(v) else v
    for k, event, ts, kind, *rest in zip(*(pdf[c] for c in COLUMNS)):
        rest = tuple(map(known, rest))
        yield k, event, ts.timestamp(), kind, rest[:3], rest[3:]


def throttle_events(events: DataFrame, p: ThrottleParams = ThrottleParams()) -> DataFrame:
    """``(session_id, event_id, why)`` of the events after which an answer is due, of a batch.

    The first position of a session, a position far enough from the last one emitted (``moved``), and
    the first event after which settings or site count differ from what held then (``settings``), a
    settings event itself if a position is known. A fix without a position is passed over; a session
    without events for ``idle_s`` begins anew. A task streams its sessions in order and holds one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, session = None, Session()
        for pdf in batches:
            out = []
            for k, event, *rest in _events(pdf):
                if k != now:
                    now, session = k, Session()
                why = session.step(*rest, p)
                if why:
                    out.append((k, event, why))
            yield pd.DataFrame(out, columns=["session_id", "event_id", "why"])

    return events.select(COLUMNS).repartition("session_id").sortWithinPartitions("session_id", "ts", "event_id").mapInPandas(run, OUT)


class _Throttle(StatefulProcessor):
    """The same for a stream: a session's state lasts over batches and restarts, and goes when the
    watermark is ``idle_s`` beyond its last event."""

    def __init__(self, p: ThrottleParams):
        self.p = p

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", STATE)

    def handleInputRows(self, key, rows, timerValues):
        session = Session(self.state.get() if self.state.exists() else None)
        # one micro-batch's events of one session
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for k, event, *rest in _events(pdf):
            why = session.step(*rest, self.p)
            if why:
                out.append((k, event, why))
        self.state.update(session.values())
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(int((session.seen + self.p.idle_s) * 1000))
        yield pd.DataFrame(out, columns=["session_id", "event_id", "why"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield pd.DataFrame(columns=["session_id", "event_id", "why"]).astype({"session_id": "int64", "event_id": "int64", "why": "object"})

    def close(self) -> None:
        pass


def throttle_event_stream(fixes: DataFrame, settings: DataFrame, p: ThrottleParams = ThrottleParams(), late_s: int = 60) -> DataFrame:
    """``throttle_events`` of two streams, fixes ``(session_id, event_id, ts, lat, lon, alt_m)`` and settings
    ``(session_id, event_id, ts, clearance_m, margin_m, sites)``, within each micro-batch in order.

    The session must keep its state in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    Events more than ``late_s`` seconds behind the newest may find their session's state gone.
    """
    none = {c: F.lit(None).cast("double") for c in COLUMNS[4:]}
    a = fixes.withColumns({**none, **{c: F.col(c).cast("double") for c in COLUMNS[4:7]}, "kind": F.lit("fix")}).select(COLUMNS)
    b = settings.withColumns({**none, **{c: F.col(c).cast("double") for c in COLUMNS[7:]}, "kind": F.lit("settings")}).select(COLUMNS)
    both = a.unionByName(b).withWatermark("ts", f"{late_s} seconds")
    return both.groupBy("session_id").transformWithStateInPandas(_Throttle(p), OUT, "append", "EventTime")
