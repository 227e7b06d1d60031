"""Movement throttle for position fixes: batch fold and stateful stream."""

from __future__ import annotations

from math import asin, cos, radians, sin, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glidemesh.functions import geo


def _moved(last: tuple[float, float, float], now: tuple[float, float, float], move_m: float, climb_m: float) -> bool:
    """Whether a fix ``(lat, lon, alt)`` is far enough, across or up, from the last one emitted."""
    if abs(now[2] - last[2]) >= climb_m:
        return True
    a, b = radians(last[0]), radians(now[0])
    h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin((radians(now[1]) - radians(last[1])) / 2) ** 2
    return 2 * geo.EARTH_M * asin(sqrt(min(1.0, h))) >= move_m


def throttle_batch(track: DataFrame, move_m: float = 400.0, climb_m: float = 75.0) -> DataFrame:
    """Fixes that moved far enough since the last *emitted* one: a fold over each session's order.

    Sessions are dealt to partitions and sorted there; the fold goes through a partition batch by
    batch and holds one fix, so a session of any length needs no more memory than a short one.
    """

    def run(batches):
        session = last = None
        for pdf in batches:
            keep = []
            for k, lat, lon, alt in zip(pdf.session_id, pdf.lat, pdf.lon, pdf.alt_m):
                now = (lat, lon, alt)
                go = k != session or _moved(last, now, move_m, climb_m)
                if go:
                    session, last = k, now
                keep.append(go)
            yield pdf.loc[keep, ["session_id", "event_id", "n"]]

    kinds = {f.name: f.dataType.simpleString() for f in track.schema}
    out = ", ".join(f"{c} {kinds[c]}" for c in ("session_id", "event_id", "n"))
    dealt = track.select("session_id", "event_id", "n", *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "alt_m")])
    return dealt.repartition("session_id").sortWithinPartitions("session_id", "n").mapInPandas(run, out)


def throttle_stream(fixes: DataFrame, move_m: float = 400.0, climb_m: float = 75.0) -> DataFrame:
    """The same on a stream of ``(session_id, event_id, ts, lat, lon, alt_m)``; state: the last one emitted."""

    def run(key, batches, state):
        last = state.get if state.exists else None
        out = []
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"])
            for event, lat, lon, alt in zip(pdf.event_id, pdf.lat, pdf.lon, pdf.alt_m):
                now = (float(lat), float(lon), float(alt))
                if last is None or _moved(last, now, move_m, climb_m):
                    last = now
                    out.append((key[0], event))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["session_id", "event_id"])

    return fixes.groupBy("session_id").applyInPandasWithState(
        run, "session_id long, event_id long", "lat double, lon double, alt_m double", "append", "NoTimeout"
    )


def latest_per_session(requests: DataFrame) -> DataFrame:
    """Only the newest request of a session counts."""
    return requests.groupBy("session_id").agg(F.max("event_id").alias("event_id"))
