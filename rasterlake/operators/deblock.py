"""The loop filter of the lossy format: edges of blocks smoothed in an order that matters, a wavefront at a time.

A block's edges read and change up to four samples of the blocks before it, so it must
follow the blocks to its left, above and above right.  Blocks with the same x + 2 y
depend on none of each other: all their lines are filtered as arrays.  A frame takes
columns + 2 (rows - 1) rounds, whatever its area; Spark deals out the frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planes import to_planes


def block_level(level: Column, reference_delta: Column, mode_delta: Column) -> Column:
    """A block's filter level, 0 to 63, from its frame's or segment's and the deltas of its reference frame and mode."""
    return F.greatest(F.lit(0), F.least(F.lit(63), level + reference_delta + mode_delta))


def with_levels(planes: DataFrame, blocks: DataFrame, columns: int, rows: int) -> DataFrame:
    """Planes with ``levels`` and ``inner``, a byte for each of columns x rows blocks, from rows (picture_id, tx, ty, level, inner).

    A block without a row is not filtered.  ``inner`` says whether its inner edges are.
    """
    cells = blocks.select("picture_id", F.col("tx").alias("x"), F.col("ty").alias("y"), F.greatest(F.lit(0), F.least(F.lit(63), F.col("level"))).alias("level"), F.col("inner").cast("int").alias("inner"))
    maps = to_planes(cells, columns, rows, "picture_id", levels=F.col("level"), inner=F.col("inner"))
    return planes.join(maps.select("picture_id", "levels", "inner"), "picture_id", "left")


def _tuning(level: np.ndarray, sharpness: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge limit, inner limit, threshold of high variance) of levels."""
    inner = level.copy()
    if sharpness:
        inner = np.minimum(inner >> (2 if sharpness > 4 else 1), 9 - sharpness)
    inner = np.maximum(inner, 1)
    return 2 * level + inner, inner, np.where(level >= 40, 2, np.where(level >= 15, 1, 0))


def _smooth(flat: np.ndarray, at: np.ndarray, step: int, limit: np.ndarray, inner: np.ndarray, high: np.ndarray, kind: str) -> None:
    """Filters lines across edges: ``at`` is the first sample behind the edge of each line."""
    s = flat[at[:, None] + step * np.arange(-4 if kind != "simple" else -2, 4 if kind != "simple" else 2)]
    half = s.shape[1] // 2
    p0, p1, q0, q1 = s[:, half - 1], s[:, half - 2], s[:, half], s[:, half + 1]
    on = 4 * np.abs(p0 - q0) + np.abs(p1 - q1) <= 2 * limit + 1
    if kind != "simple":
        flatness = np.abs(np.diff(s, axis=1))
        flatness[:, 3] = 0
        on &= (flatness <= inner[:, None]).all(axis=1)
    if not on.any():
        return
    narrow = np.clip(p1 - q1, -128, 127)
    wild = np.ones(len(at), bool) if kind == "simple" else (np.abs(p1 - p0) > high) | (np.abs(q1 - q0) > high)
    new = {k: flat[at + step * k] for k in (range(-3, 3) if kind == "edge" else range(-2, 2))}

    def put(k: int, where: np.ndarray, change: np.ndarray) -> None:
        new[k] = np.where(where & on, np.clip(new[k] + change, 0, 255), new[k])

    a = 3 * (q0 - p0) + narrow
    put(-1, wild, np.clip((a + 3) >> 3, -16, 15))
    put(0, wild, -np.clip((a + 4) >> 3, -16, 15))
    if kind == "edge":
        a = np.clip(a, -128, 127)
        for k, weight in enumerate((27, 18, 9)):
            change = (weight * a + 63) >> 7
            put(-1 - k, ~wild, change)
            put(k, ~wild, -change)
    elif kind == "inner":
        a = 3 * (q0 - p0)
        near, far = np.clip((a + 4) >> 3, -16, 15), np.clip((a + 3) >> 3, -16, 15)
        put(-1, ~wild, far)
        put(0, ~wild, -near)
        put(-2, ~wild, (near + 1) >> 1)
        put(1, ~wild, -((near + 1) >> 1))
    for k, v in new.items():
        flat[at + step * k] = v


def filtered(plane: np.ndarray, levels: np.ndarray, inner: np.ndarray, size: int, sharpness: int = 0, simple: bool = False) -> np.ndarray:
    """A plane whose blocks of ``size`` have levels (rows, columns) and inner flags; it is filled up to whole blocks and cut again."""
    rows, columns = levels.shape
    wide = np.pad(plane, [(0, rows * size - plane.shape[0]), (0, columns * size - plane.shape[1])], mode="edge").astype(np.int32)
    flat, stride, line = wide.reshape(-1), columns * size, np.arange(size)
    edge_limit, inner_limit, high = _tuning(levels.astype(np.int32), sharpness)

    def across(y: np.ndarray, x: np.ndarray, offset: int, step: int, limit: np.ndarray, kind: str) -> None:
        if len(x):
            along = stride if step == 1 else 1
            at = ((y * size) * stride + x * size + offset * step)[:, None] + along * line
            own = lambda v: np.repeat(v[y, x], size)
            _smooth(flat, at.ravel(), step, own(limit), own(inner_limit), own(high), "simple" if simple else kind)

    for wave in range(columns + 2 * (rows - 1)):
        y = np.arange(max(0, -(-(wave - columns + 1) // 2)), min(rows - 1, wave // 2) + 1)
        x = wave - 2 * y
        on = levels[y, x] > 0
        y, x = y[on], x[on]
        for step, before in ((1, x > 0), (stride, y > 0)):
            across(y[before], x[before], 0, step, edge_limit + 4, "edge")
            deep = inner[y, x] > 0
            for offset in range(4, size, 4):
                across(y[deep], x[deep], offset, step, edge_limit, "inner")
    return wide[: plane.shape[0], : plane.shape[1]].astype(np.uint8)


def deblocked(planes: DataFrame, sharpness: int = 0, simple: bool = False) -> DataFrame:
    """Planes (luma, and cb, cr at half size) filtered by their ``levels`` and ``inner``; the simple filter leaves colour alone.

    Frames without levels stay as they are.  Macroblocks are 16 samples wide, 8 in colour.
    """
    names = ["luma"] if simple else [n for n in ("luma", "cb", "cr") if n in planes.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: batch.column(n).to_pylist() for n in names}
            for i, (w, h, levels, inner) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("width", "height", "levels", "inner")))):
                if levels is None or not w or not h:
                    continue
                shape = (-(-h // 16), -(-w // 16))
                of = lambda b: np.frombuffer(b, np.uint8).reshape(shape)  # noqa: B023, E731
                for n in names:
                    tall = h if n == "luma" else (h + 1) // 2
                    plane = np.frombuffer(out[n][i], np.uint8).reshape(tall, -1)
                    out[n][i] = filtered(plane, of(levels), of(inner), 16 if n == "luma" else 8, sharpness, simple).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.binary()) if c in out else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return planes.mapInArrow(run, planes.schema)
