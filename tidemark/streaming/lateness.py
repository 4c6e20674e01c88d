"""A stateful window operator with allowed lateness, corrected re-emissions and late rows.

The engine hides rows behind its own watermark, so that is given a delay wide enough to hide none, and the
operator takes the watermark that it works by from there: the engine's, plus the delay, less the bound.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.aggregates import Aggregator
from tidemark.operators.windows import Session, Sliding, Tumbling

#: What follows the keys, with the type of the aggregate between the two.
CELL, LATE = "window_start_ms long, window_end_ms long, result", "event_ms long, value long, is_late boolean"


class LateWindows(StatefulProcessor):
    """Windows by key. Rows of one micro-batch share its watermark, which the batch before it left.

    State is one entry a window: start to end, accumulator, and whether it has changed since it was last emitted. A
    batch's rows are folded by window before state is touched, once for each window.
    """

    def __init__(self, keys: list[str], windows: Tumbling | Sliding | Session, aggregator: Aggregator, bound_ms: int, lateness_ms: int, delay_ms: int) -> None:
        self.columns = [*keys, "window_start_ms", "window_end_ms", "result", "event_ms", "value", "is_late"]
        self.windows, self.aggregator = windows, aggregator
        self.bound, self.lateness, self.delay = bound_ms, lateness_ms, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("windows", "start long", "end long, acc binary, dirty boolean")

    def close(self) -> None:
        pass

    def _watermark(self, timers: Any) -> int | None:
        own = timers.getCurrentWatermarkInMs()
        return own + self.delay - self.bound if own > 0 else None

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(max(at - self.delay + self.bound, 1))

    def _emitted(self, key: tuple, start: int, end: int, acc: Any) -> tuple:
        return (*key, start, end, self.aggregator.result(acc), None, None, False)

    def _put(self, start: int, end: int, acc: Any, dirty: bool) -> None:
        self.held.updateValue((start,), (end, pickle.dumps(acc), dirty))

    def _settle(self, key: tuple, start: int, end: int, acc: Any, dirty: bool, wm: int | None, out: list[tuple], early: int = 1) -> None:
        """Emits a window that the watermark has passed and that has changed, and forgets or keeps it.

        early: how long before a time its timer is set, since whether it's due at its time or after it is the engine's affair.
        """
        if wm is None or end > wm:
            self._put(start, end, acc, dirty)
            self._timer(end - early)
            return
        if dirty:
            out.append(self._emitted(key, start, end, acc))
        if end + self.lateness <= wm:
            self.held.removeKey((start,))
        else:
            self._put(start, end, acc, False)
            self._timer(end + self.lateness - early)

    def _fixed(self, ms: np.ndarray, wm: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Row and window start, for each window that takes a row; rows in their order."""
        size, slide = self.windows.size, getattr(self.windows, "slide", self.windows.size)
        starts = (ms - ms % slide)[:, None] - np.arange((size - 1) // slide + 1) * slide
        takes = starts + size > ms[:, None]
        if wm is not None:
            takes &= starts + size + self.lateness > wm
        return np.nonzero(takes)[0], starts[takes]

    def _sessions(self, key: tuple, frame: pd.DataFrame, wm: int | None, out: list[tuple]) -> None:
        """Joins sessions that overlap, with those held; one that only touches another stays apart."""
        gap, found = self.windows.gap, []
        for (start,), (end, acc, dirty) in list(self.held.iterator()):
            if wm is not None and end + self.lateness <= wm:  # over before these rows came
                self._settle(key, start, end, pickle.loads(acc), dirty, wm, out)
            else:
                found.append([start, end, pickle.loads(acc), False])
        by_time = frame["event_ms"].sort_values(kind="stable")
        session = (by_time.diff() >= gap).cumsum()
        for _, own in frame.groupby(session.reindex(frame.index), sort=True):  # rows in order of arrival
            new = self.aggregator.fold(self.aggregator.create(), own["value"].tolist())
            found.append([int(own["event_ms"].min()), int(own["event_ms"].max()) + gap, new, True])
        found.sort(key=lambda x: x[:2])
        joined: list[list] = []
        for start, end, acc, new in found:
            if joined and start < joined[-1][1]:
                last = joined[-1]
                last[1], last[2], last[3] = max(last[1], end), self.aggregator.merge(last[2], acc), True
                if not new:
                    self.held.removeKey((start,))
            else:
                joined.append([start, end, acc, new])
        for start, end, acc, changed in joined:
            if changed:
                self._settle(key, start, end, acc, True, wm, out)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wm, out = self._watermark(timerValues), []
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable", ignore_index=True)
        ms = frame["event_ms"].to_numpy()
        if isinstance(self.windows, Session):
            live = np.ones(len(ms), dtype=bool) if wm is None else ms + self.windows.gap + self.lateness > wm
            if live.any():
                self._sessions(key, frame[live].reset_index(drop=True), wm, out)
        else:
            row, starts = self._fixed(ms, wm)
            live = np.isin(np.arange(len(ms)), row)
            for start, values in frame["value"].take(row).groupby(starts):
                start = int(start)
                held = self.held.getValue((start,)) if self.held.containsKey((start,)) else None
                acc = self.aggregator.create() if held is None else pickle.loads(held[1])
                self._settle(key, start, start + self.windows.size, self.aggregator.fold(acc, values.tolist()), True, wm, out)
        late = frame[~live]
        out += [(*key, None, None, None, m, v, True) for m, v in zip(late["event_ms"].tolist(), late["value"].tolist(), strict=True)]
        yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wm, out = self._watermark(timerValues), []
        own = expiredTimerInfo.getExpiryTimeInMs()
        at = own + self.delay - self.bound
        if isinstance(self.windows, Session) or own <= 1:  # 1 stands for all times up to it
            due = [s for (s,), (end, _, _) in list(self.held.iterator()) if end <= at + 1]
        else:
            ends = {at, at + 1, at - self.lateness, at + 1 - self.lateness}
            due = [s for s in sorted(e - self.windows.size for e in ends) if self.held.containsKey((s,))]
        for start in due:
            end, acc, dirty = self.held.getValue((start,))
            self._settle(key, start, end, pickle.loads(acc), dirty, wm, out, early=0)
        yield pd.DataFrame(out, columns=self.columns, dtype=object)


def late_windows(
    stream: DataFrame, keys: list[str], windows: Tumbling | Sliding | Session, aggregator: Aggregator, kind: str, bound_ms: int, lateness_ms: int, delay_ms: int
) -> DataFrame:
    """The aggregate (of the SQL type kind) of value by keys and windows over rows with seq, event_ms and value.

    Emissions (is_late false): keys, window, result; the last by keys and window counts. Rows that no window takes
    (is_late true): keys, event_ms, value. A session that grows at its front is emitted under its new start.
    """
    operator = LateWindows(keys, windows, aggregator, bound_ms, lateness_ms, delay_ms)
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.select(*keys).schema)
    return stream.groupBy(*keys).transformWithStateInPandas(operator, f"{named}, {CELL} {kind}, {LATE}", "Update", "EventTime")
