"""A windower with triggers and bounds, and its form as a stateful Spark operator.

One firing per window at watermark >= end + lateness; count and interval
triggers fire before; bounds on records and open windows fire early.  Times are
seconds since the epoch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..operators.windows import ZERO_TO_EPOCH

CONTINUE, FIRE, FIRE_PURGE = 0, 1, 2


class LateRecord(ValueError):
    """A record came after its windows had closed, under the policy that this is an error."""


@dataclass
class Pane:
    start: float | None
    end: float | None
    key: str
    seq: int
    ids: list[str]
    final: bool
    late: bool
    watermark: float | None

    @property
    def count(self) -> int:
        return len(self.ids)


@dataclass
class Open:
    rows: list[tuple[float, str]] = field(default_factory=list)
    fired: int = 0
    late: bool = False
    due: float | None = None
    start: float | None = None


def at_watermark() -> Callable:
    return lambda state, spec, mark: CONTINUE


def at_count(n: int) -> Callable:
    return lambda state, spec, mark: FIRE_PURGE if len(state.rows) >= n else CONTINUE


def at_interval(seconds: float) -> Callable:
    """Fires whenever the watermark has come so many seconds further from the window's start, and keeps the rows; a global window counts from the first look."""

    def ask(state: Open, spec: Windower, mark: float | None) -> int:
        if mark is None or not state.rows or spec.adding:
            return CONTINUE
        if state.due is None:
            state.due = (mark if state.start is None else state.start) + seconds
        if mark < state.due:
            return CONTINUE
        while state.due <= mark:
            state.due += seconds
        return FIRE

    return ask


def any_of(*triggers: Callable) -> Callable:
    """The strongest action of several."""
    return lambda state, spec, mark: max(t(state, spec, mark) for t in triggers)


class Windower:
    def __init__(self, size: float = 0, slide: float = 0, lateness: float = 0, *, trigger: Callable | None = None, late_policy: str = "drop", max_records: int = 0, max_windows: int = 0):
        if size < 0 or lateness < 0 or max_records < 0 or max_windows < 0 or slide < 0:
            raise ValueError("sizes, lateness and bounds can't be negative")
        if slide > size:
            raise ValueError("a slide can't be larger than its window")
        if not size and trigger is None and not max_records:
            raise ValueError("a global window needs a trigger or a bound on records")
        self.size, self.slide, self.lateness = size, slide or size, lateness
        self.trigger, self.late_policy = trigger or at_watermark(), late_policy
        self.max_records, self.max_windows = max_records, max_windows
        self.open: dict[tuple, Open] = {}
        self.mark: float | None = None
        self.adding = False
        self.stats = dict.fromkeys(("records", "assigned", "panes", "early", "late", "dropped", "evicted"), 0)

    def windows(self, t: float) -> list[tuple[float | None, float | None]]:
        """Half-open windows that hold t, the oldest first, cut from the year 1."""
        if not self.size:
            return [(None, None)]
        last = t - (t + ZERO_TO_EPOCH) % self.slide
        out, s = [], last
        while s + self.size > t:
            out.append((s, s + self.size))
            s -= self.slide
        return out[::-1]

    def _closed(self, end: float | None) -> bool:
        return end is not None and self.mark is not None and self.mark >= end + self.lateness

    def _fire(self, window: tuple, final: bool, purge: bool) -> Pane | None:
        state = self.open[window]
        if not state.rows:
            return None
        state.fired += 1
        pane = Pane(window[0], window[1], window[2], state.fired, [i for _, i in sorted(state.rows)], final, state.late, self.mark)
        self.stats["panes"] += 1
        self.stats["early"] += not final
        self.stats["late"] += state.late
        if purge:
            state.rows, state.late = [], False
        return pane

    def add(self, record_id: str, t: float, key: str = "") -> list[Pane]:
        """Panes that a record sets off; each of its windows that has closed counts as dropped, or is an error by the policy."""
        out, assigned = [], 0
        self.adding = True
        for s, e in self.windows(t):
            if self._closed(e):
                self.stats["dropped"] += 1
                if self.late_policy == "fail":
                    raise LateRecord(f"{record_id}: the window up to {e} has closed")
                continue
            assigned += 1
            window = (s, e, key)
            state = self.open.setdefault(window, Open(start=s))
            state.rows.append((t, record_id))
            self.stats["assigned"] += 1
            state.late |= e is not None and self.mark is not None and self.mark >= e
            if self.max_records and len(state.rows) >= self.max_records:
                self.stats["evicted"] += 1
                out.append(self._fire(window, False, True))
            elif action := self.trigger(state, self, self.mark):
                out.append(self._fire(window, False, action == FIRE_PURGE))
        self.adding = False
        self.stats["records"] += assigned > 0
        while self.max_windows and len(self.open) > self.max_windows:
            oldest = min(self.open, key=self._order)
            self.stats["evicted"] += 1
            out.append(self._fire(oldest, True, True))
            del self.open[oldest]
        return self._ordered(out)

    def _ordered(self, panes: list[Pane | None]) -> list[Pane]:
        """Panes in order of end, start, key and number."""
        return sorted((p for p in panes if p), key=lambda p: (*self._order((p.start, p.end, p.key)), p.seq))

    @staticmethod
    def _order(w: tuple) -> tuple:
        # the global window's end is the zero time, before all others
        return (w[1] if w[1] is not None else float("-inf"), w[0] if w[0] is not None else float("-inf"), w[2])

    def advance(self, mark: float) -> list[Pane]:
        """The watermark, never back; closed windows fire in order of end, start, key."""
        if self.mark is not None and mark <= self.mark:
            return []
        self.mark = mark
        out = []
        for w in sorted(self.open, key=self._order):
            if self._closed(w[1]):
                out.append(self._fire(w, True, True))
                del self.open[w]
            elif (action := self.trigger(self.open[w], self, self.mark)) and self.open[w].rows:
                out.append(self._fire(w, False, action == FIRE_PURGE))
        return self._ordered(out)

    def drain(self) -> list[Pane]:
        """Everything that is open fires as final."""
        out = [self._fire(w, True, True) for w in sorted(self.open, key=self._order)]
        self.open = {}
        return [p for p in out if p]

    def snapshot(self) -> str:
        return json.dumps({"mark": self.mark, "stats": self.stats, "open": [[list(w), s.rows, s.fired, s.late, s.due, s.start] for w, s in self.open.items()]})

    def restore(self, blob: str) -> None:
        d = json.loads(blob)
        self.mark, self.stats = d["mark"], d["stats"]
        self.open = {tuple(w): Open([tuple(r) for r in rows], *rest) for w, rows, *rest in d["open"]}


PANE_SCHEMA = "key string, window_start double, window_end double, pane_seq int, ids array<string>, final boolean, late boolean"


def stateful(df, *, key: str, record_id: str, ts: str, make: Callable[[], Windower]):
    """Panes of a stream with triggers per key: `ts` in seconds, state in Spark's store, one windower per key.

    The watermark is Spark's; a key's windows are looked at when rows of the
    key come.  Bounds on open windows hold per key.
    """
    import pandas as pd
    from pyspark.sql import functions as F
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import StringType, StructField, StructType

    class Keyed(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("windower", StructType([StructField("blob", StringType())]))

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
            w = make()
            if self.state.exists():
                w.restore(self.state.get()[0])
            panes: list[Pane] = []
            for pdf in rows:
                for i, t in sorted(zip(pdf["id"], pdf["t"], strict=True), key=lambda x: (x[1], x[0])):
                    panes += w.add(str(i), float(t), key[0])
            mark = timer_values.getCurrentWatermarkInMs()
            if mark > 0:
                panes += w.advance(mark / 1000)
            self.state.update((w.snapshot(),))
            yield pd.DataFrame(
                {"key": [p.key for p in panes], "window_start": [p.start for p in panes], "window_end": [p.end for p in panes], "pane_seq": [p.seq for p in panes], "ids": [p.ids for p in panes], "final": [p.final for p in panes], "late": [p.late for p in panes]}
            ).astype({"pane_seq": "int32", "final": "bool", "late": "bool"})

        def close(self) -> None:
            pass

    own = df.select(F.col(key).cast("string").alias("key"), F.col(record_id).cast("string").alias("id"), F.col(ts).alias("event_time"), F.col(ts).cast("double").alias("t"))
    return own.groupBy("key").transformWithStateInPandas(Keyed(), PANE_SCHEMA, outputMode="append", timeMode="eventTime")
