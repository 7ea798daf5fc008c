"""Frames that arrive over time: watched folders and per-animation state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.registry import decode_files
from ..sources.webp import over

_OUT = "picture_id bigint, frame_idx int, x int, y int, width int, height int, keyframe boolean"
_STATE = "width int, height int, frames bigint, argb binary"


def watch_folder(spark: SparkSession, path: str, per_trigger: int = 100, permissive: bool = True) -> DataFrame:
    """Frames of files as they land in a folder; a bad file is a row with its error."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    landed = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)
    return decode_files(landed, permissive)


def frames_per_window(frames: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Frames and shown milliseconds of each animation in tumbling windows; rows later than ``late`` are dropped."""
    windows = frames.withWatermark(time, late).groupBy(F.window(time, length), "picture_id")
    return windows.agg(F.count("*").alias("frames"), F.sum("delay_ms").alias("shown_ms"))


def _box(before: np.ndarray | None, now: np.ndarray, w: int, every: int, n: int) -> tuple:
    h = len(now) // w
    if before is None or len(before) != len(now) or (every > 0 and n % every == 0):
        return 0, 0, w, h, True
    at = np.flatnonzero(before != now)
    if not len(at):
        return 0, 0, 1, 1, False
    x0, y0, x1, y1 = int((at % w).min()) & ~1, int(at[0] // w) & ~1, int((at % w).max()), int(at[-1] // w)
    return x0, y0, x1 - x0 + 1, y1 - y0 + 1, False


def delta_stream(frames: DataFrame, keyframe_every: int = 0) -> DataFrame:
    """For each arriving frame the box that changed since the animation's last frame.

    State is one frame a key: the last one, with its size and number.  A new size or
    a multiple of ``keyframe_every`` gives a whole frame.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        w, h, n, held = state.get if state.exists else (0, 0, 0, b"")
        last = np.frombuffer(held, np.int32) if held else None
        rows = pd.concat(list(batches)).sort_values("frame_idx")
        out = []
        for r in rows.itertuples(index=False):
            now = np.asarray(r.argb, np.int32)
            same = last if (w, h) == (r.width, r.height) else None
            out.append((key[0], r.frame_idx, *_box(same, now, r.width, keyframe_every, n)))
            last, w, h, n = now, r.width, r.height, n + 1
        if last is not None:
            state.update((int(w), int(h), int(n), last.tobytes()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return frames.groupBy("picture_id").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")


def composed(frames: DataFrame, width: int, height: int, background: int = 0) -> DataFrame:
    """Whole canvases of animations whose frames are boxes with offset, disposal and blend, in order of frame_idx."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        canvas, gone, out = np.full((height, width), background, np.uint32), None, []
        for r in rows.sort_values("frame_idx").itertuples(index=False):
            if gone:
                canvas[gone] = background
            y, x = slice(max(0, r.offset_y), min(height, r.offset_y + r.height)), slice(max(0, r.offset_x), min(width, r.offset_x + r.width))
            p = np.asarray(r.argb, np.int32).view(np.uint32).reshape(r.height, r.width)
            p = p[y.start - r.offset_y : y.stop - r.offset_y, x.start - r.offset_x : x.stop - r.offset_x]
            canvas[y, x] = p if r.blend == "SOURCE" else over(p, canvas[y, x])
            gone = (y, x) if r.disposal == "RESTORE_TO_BACKGROUND" else None
            out.append((r.picture_id, r.frame_idx, width, height, r.delay_ms, canvas.view(np.int32).ravel().copy()))
        return pd.DataFrame(out, columns=["picture_id", "frame_idx", "width", "height", "delay_ms", "argb"])

    return frames.groupBy("picture_id").applyInPandas(fold, "picture_id bigint, frame_idx int, width int, height int, delay_ms int, argb array<int>")
