"""Reference frames as streaming state: the last, the golden and the alternate frame of each animation.

Each animation's three frames are three named states, so a frame that changes one of
them writes only that one.  Frames of a batch are taken in order of frame_idx.  Updates
follow the format: first copies between the states, with what they held before, the
alternate one before the golden one and only where the same frame does not replace the target; then the
frame itself replaces what it refreshes.  A key frame replaces all three.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

_SLOTS = ("last", "golden", "alternate")
#: What a copy flag names, for the golden and for the alternate frame.
_SOURCES = {"golden": {1: "last", 2: "alternate"}, "alternate": {1: "last", 2: "golden"}}
_OUT = "picture_id bigint, frame_idx int, status string, last_idx int, golden_idx int, alternate_idx int, last binary, golden binary, alternate binary"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


class References(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        frame = StructType([StructField("frame_idx", IntegerType()), StructField("plane", BinaryType())])
        self.slots = {n: handle.getValueState(n, frame) for n in _SLOTS}
        self.seen = handle.getValueState("seen", StructType([StructField("frame_idx", IntegerType())]))
        self.timer = handle.getValueState("timer", StructType([StructField("at", LongType())]))

    def _update(self, row) -> None:
        now = (int(row.frame_idx), bytes(row.plane))
        before = {n: s.get() if s.exists() else None for n, s in self.slots.items()}
        fresh = {n: bool(row.is_key) or bool(getattr(row, f"refresh_{n}")) for n in _SLOTS}
        for n in ("alternate", "golden"):
            source = _SOURCES[n].get(int(getattr(row, f"copy_to_{n}")))
            if source and not fresh[n] and before[source] is not None:
                self.slots[n].update(before[source])
                before[n] = before[source]
        for n in _SLOTS:
            if fresh[n]:
                self.slots[n].update(now)

    def _row(self, key: int, frame_idx: int | None, status: str) -> tuple:
        held = [s.get() if s.exists() else (None, None) for s in self.slots.values()]
        return (key, frame_idx, status, *(h[0] for h in held), *(h[1] for h in held))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values("frame_idx", kind="stable").itertuples(index=False):
            late = seen is not None and row.frame_idx <= seen
            missing = seen is None and not row.is_key
            if not late and not missing:
                self._update(row)
                seen = int(row.frame_idx)
            out.append(self._row(key[0], int(row.frame_idx), "late" if late else "no reference" if missing else "ok"))
        if seen is not None:
            self.seen.update((seen,))
        if self.idle_ms:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [self._row(key[0], None, "expired")]
        for state in (*self.slots.values(), self.seen, self.timer):
            state.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def reference_stream(frames: DataFrame, idle_ms: int = 0) -> DataFrame:
    """What each animation's three references hold after each frame, as they arrive.

    ``frames``: picture_id, frame_idx, is_key, refresh_last, refresh_golden,
    refresh_alternate, copy_to_golden (1 the last, 2 the alternate), copy_to_alternate
    (1 the last, 2 the golden), plane.  Status ``late``: its frame_idx is not above the
    highest taken, in this batch or before; it changes nothing.  ``no reference``: no
    key frame came yet; it changes nothing.  After ``idle_ms`` without a frame an
    animation's state goes, with a row of what it held (``expired``); 0 keeps it.
    """
    return frames.groupBy("picture_id").transformWithStateInPandas(References(idle_ms), _OUT, "append", "ProcessingTime" if idle_ms else "None")
