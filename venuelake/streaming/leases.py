"""Leases as keyed state with event-time timers: granted, held, completed, late or expired."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Minutes that a lease of each kind lasts.
MINUTES = {"WORK": 10, "RUN": 30, "ALERT": 5, "BATCH": 360}
COMPLETE = "COMPLETE"
_OUTCOMES = "key {key}, id bigint, at timestamp, outcome string"


class Leases(StatefulProcessor):
    """What a key holds: the events that may still be overtaken by earlier ones, its lease, and one timer.

    Events wait until the watermark has passed them, then are folded in order of time and id, so the order of their arrival
    makes no difference. The timer stands at the first waiting event or the lease's end, whichever is sooner.
    """

    def __init__(self, minutes: dict[str, int]) -> None:
        self.micros = {kind: m * 60_000_000 for kind, m in minutes.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id bigint, kind string")
        self.lease = handle.getValueState("lease", "timer bigint, ends bigint, id bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        events = [(r["at"], r["id"], r["kind"]) for r in rows]
        self.waiting.appendList(events)
        timer, ends, number = self.lease.get() if self.lease.exists() else (None, None, None)
        first = _millis(min(e[0] for e in events))
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            self.lease.update((first, ends, number))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(e) for e in self.waiting.get())
        due, later = [e for e in events if e[0] <= upto], [e for e in events if e[0] > upto]
        _, ends, held = self.lease.get()
        out = []
        for at, number, kind in [*due, (upto, None, None)]:
            if ends is not None and ends <= at:
                out.append((held, ends, "EXPIRED"))
                ends = held = None
            if kind == COMPLETE:
                out.append((number, at, "LATE" if ends is None else "COMPLETED"))
                ends = held = None
            elif kind is not None and ends is not None:
                out.append((number, at, "HELD"))
            elif kind is not None:
                out.append((number, at, "GRANTED"))
                ends, held = at + self.micros[kind], number
        self.waiting.put(later) if later else self.waiting.clear()
        ahead = [t for t in (later[0][0] if later else None, ends) if t is not None]
        if ahead:
            timer = _millis(min(ahead))
            self.handle.registerTimer(timer)
            self.lease.update((timer, ends, held))
        else:
            self.lease.clear()
        return iter([Row(key=key[0], id=i, at=_timestamp(at), outcome=o) for i, at, o in out])

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def _timestamp(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


def lease_outcomes(events: DataFrame, key: str, at: str, event_id: str, kind: Column, delay: str, minutes: dict[str, int] | None = None) -> DataFrame:
    """(key, id, at, outcome) of a stream of reservations and completions, final as the watermark passes them.

    `kind` is one of `minutes`, a reservation, or COMPLETE; other events, and those without key, time or id, are left out. A
    reservation is GRANTED, or HELD while the key has a lease; a completion is COMPLETED, or LATE without one. A lease that is not
    completed before its end is EXPIRED at that instant, ahead of an event of the same instant; that row has the id of its
    reservation. Events of one instant go by id. Those later than `delay` behind the newest are dropped. The stream must be
    started inside `state.rocksdb`. A key's events are one sequence, so one task has them; its state is one lease and the
    events within `delay`.
    """
    spans = MINUTES if minutes is None else minutes
    rows = events.withWatermark(at, delay).select(F.col(key).alias("key"), F.col(at).alias("time"), F.unix_micros(F.col(at)).alias("at"), F.col(event_id).cast("bigint").alias("id"), kind.alias("kind"))
    whole = rows.filter(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("id").isNotNull() & F.col("kind").isin(*spans, COMPLETE))
    schema = _OUTCOMES.format(key=dict(rows.dtypes)["key"])
    return whole.groupBy("key").transformWithState(Leases(spans), schema, "Append", "EventTime")
