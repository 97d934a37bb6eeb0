"""What streams keep of a key between batches, with timers of event time that let it go.

Each call to the store is a round trip for a key, so timers are lazy: a key has one at most, which is not moved when the
key's time grows, but looks at it when it fires and is set again if the time has not come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SETTLED = ("complete", "failed")
#: In place of the time of a timer: there is none.
NO_TIMER = -1


def milliseconds(duration: str) -> int:
    return pd.Timedelta(duration) // pd.Timedelta(milliseconds=1)


def timer_by(handle: StatefulProcessorHandle, held: int, due: int) -> int:
    """The key's timer, at due or before; held is the one it has."""
    if NO_TIMER < held <= due:
        return held
    if held > due:
        handle.deleteTimer(held)
    handle.registerTimer(due)
    return due


class JournalStates(StatefulProcessor):
    """The last entry of an id; forgotten ``keep`` milliseconds after it was settled."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, seq long, due long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(((r["seq"], r["state"], r["at"]) for r in rows if r["seq"] is not None), key=lambda x: x[0], default=None)
        held = self.last.get()
        if best is None or held is not None and held[1] >= best[0]:
            return
        seq, state, at = best
        timer, due = NO_TIMER if held is None else held[3], NO_TIMER
        if state in SETTLED:
            due = -(-at // 1000) + self.keep
            timer = timer_by(self.handle, timer, due)
        self.last.update((state, seq, due, timer))
        yield Row(id=key[0], state=state, seq=seq, closed=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        if held is None:
            return
        state, seq, due, _ = held
        if due == NO_TIMER or due > timerValues.getCurrentWatermarkInMs():
            self.last.update((state, seq, due, NO_TIMER if due == NO_TIMER else timer_by(self.handle, NO_TIMER, due)))
            return
        self.last.clear()
        yield Row(id=key[0], state=state, seq=seq, closed=True)

    def close(self) -> None:
        pass


class IdleStates(StatefulProcessor):
    """The last event of a user, in microseconds."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, timer long")

    def due(self, at: int) -> int:
        return -(-at // 1000) + self.threshold

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        times = [r["at"] for r in rows]
        held = self.last.get()
        if held is not None:  # an event that is late, but not too late, may be older than the last one
            times.append(held[0])
        times.sort()
        for a, b in zip(times, times[1:]):
            if b - a >= self.threshold * 1000:
                yield Row(user_id=key[0], idle_from=a, idle_to=b)
        if held is None or times[-1] != held[0]:
            self.last.update((times[-1], timer_by(self.handle, NO_TIMER if held is None else held[1], self.due(times[-1]))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, _ = self.last.get()
        if (due := self.due(at)) > timerValues.getCurrentWatermarkInMs():
            self.last.update((at, timer_by(self.handle, NO_TIMER, due)))
            return
        self.last.update((at, NO_TIMER))
        yield Row(user_id=key[0], idle_from=at, idle_to=None)

    def close(self) -> None:
        pass
