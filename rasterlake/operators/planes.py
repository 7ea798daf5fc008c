"""Packed planes: one row a picture or frame, one byte a sample, row by row.

``planes`` rows are (keys..., width, height, and a binary column for each plane).
Work on them happens in Arrow batches, a frame at a time, with arrays; Spark deals
out the frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six taps of the sub-sample filter for each eighth of a sample, from two before to three after.
SIX_TAPS = (
    (0, 0, 128, 0, 0, 0),
    (0, -6, 123, 12, -1, 0),
    (2, -11, 108, 36, -8, 1),
    (0, -9, 93, 50, -6, 0),
    (3, -16, 77, 77, -16, 3),
    (0, -6, 50, 93, -9, 0),
    (1, -8, 36, 108, -11, 2),
    (0, -1, 12, 123, -6, 0),
)


def to_planes(px: DataFrame, width: int, height: int, *keys: str, **samples: Column) -> DataFrame:
    """Pixels as planes, one for each named sample (0 to 255).

    A place without a pixel is 0, pixels outside are left out, and of several at one
    place the one with the largest samples, in the order given, stays.
    """
    keys = keys or ("picture_id",)
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height)
    cell = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("k"), *(v.cast("int").alias(n) for n, v in samples.items()))
    rows = px.groupBy(*keys).agg(F.collect_list(F.when(inside, cell)).alias("cells"))
    names = list(samples)

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells")
            ends = cells.offsets.to_numpy().astype(np.int64)
            k, *v = (cells.values.field(n).to_numpy() for n in ("k", *names))
            out: dict[str, list[bytes]] = {n: [] for n in names}
            for i in range(len(batch)):
                own = slice(ends[i], ends[i + 1])
                order = np.lexsort([*(x[own] for x in reversed(v)), k[own]])
                for n, x in zip(names, v):
                    plane = np.zeros(width * height, np.uint8)
                    plane[k[own][order]] = x[own][order]
                    out[n].append(plane.tobytes())
            sizes = [pa.array([n] * len(batch), pa.int32()) for n in (width, height)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *sizes, *(pa.array(x, pa.binary()) for x in out.values())], names=[*keys, "width", "height", *names])

    kinds = dict(px.dtypes)
    return rows.mapInArrow(laid, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "width int", "height int", *(f"`{n}` binary" for n in names)]))


def to_samples(planes: DataFrame, plane: str, *keys: str) -> DataFrame:
    """A plane as rows (keys..., x, y, v)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                v = np.frombuffer(batch.column(plane)[i].as_py(), np.uint8)
                w = batch.column("width")[i].as_py()
                at = np.arange(len(v), dtype=np.int32)
                own = [pa.repeat(batch.column(c)[i], len(v)) for c in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at % w), pa.array(at // w), pa.array(v.astype(np.int32))], names=[*keys, "x", "y", "v"])

    keys = keys or ("picture_id",)
    kinds = dict(planes.dtypes)
    return planes.select(*keys, "width", plane).mapInArrow(spread, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "x int", "y int", "v int"]))


def mapped(planes: DataFrame, f: Callable[..., dict[str, np.ndarray]], *names: str) -> DataFrame:
    """Planes replaced by what f makes of them: f takes the named planes as arrays (height, width) and returns some of them anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[bytes | None]] = {n: [] for n in names}
            for i in range(len(batch)):
                w, h = batch.column("width")[i].as_py(), batch.column("height")[i].as_py()
                old = {n: np.frombuffer(batch.column(n)[i].as_py(), np.uint8).reshape(h, -1) if w and h else np.zeros((h, w), np.uint8) for n in names}
                new = f(**old)
                for n in names:
                    out[n].append(np.ascontiguousarray(new.get(n, old[n]), np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.binary()) if c in out else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return planes.mapInArrow(run, planes.schema)


def sub_sample(ref: np.ndarray, x: int, y: int, w: int, h: int, fx: int, fy: int) -> np.ndarray:
    """The w by h block at (x + fx/8, y + fy/8): six taps across, then down, rounded and clamped each time; edges repeat."""
    rows = np.clip(np.arange(y - 2, y + h + 3), 0, ref.shape[0] - 1)
    cols = np.clip(np.arange(x - 2, x + w + 3), 0, ref.shape[1] - 1)
    patch = ref[np.ix_(rows, cols)].astype(np.int32)
    across = sum(t * patch[:, k : k + w] for k, t in enumerate(SIX_TAPS[fx]))
    across = np.clip((across + 64) >> 7, 0, 255)
    down = sum(t * across[k : k + h] for k, t in enumerate(SIX_TAPS[fy]))
    return np.clip((down + 64) >> 7, 0, 255)


def shifted(planes: DataFrame, dx: int, dy: int, *names: str) -> DataFrame:
    """Planes moved by eighths of a sample: what is seen at (x, y) is what was at (x + dx/8, y + dy/8)."""

    def move(**old: np.ndarray) -> dict[str, np.ndarray]:
        return {n: sub_sample(p, dx >> 3, dy >> 3, p.shape[1], p.shape[0], dx & 7, dy & 7) if p.size else p for n, p in old.items()}

    return mapped(planes, move, *names)


def up_sampled(chroma: np.ndarray, w: int, h: int) -> np.ndarray:
    """A half-size plane at full size: nine parts the nearest sample, three each its neighbours, one the sample across.

    Rounded in two steps, as the format's decoders do.  The first column, and the last
    of an even width, take three parts the nearer and one the other row; rows repeat at
    the upper and lower edge.
    """
    def near(n: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.arange(n)
        a, b = np.where(k % 2 == 0, k // 2, (k - 1) // 2), np.where(k % 2 == 0, k // 2 - 1, (k + 1) // 2)
        edge = (b < 0) | (b >= limit)
        return a, np.where(edge, a, b), edge

    y, y2, _ = near(h, chroma.shape[0])
    x, x2, side = near(w, chroma.shape[1])
    c = chroma.astype(np.int32)
    own, row, column, across = (c[np.ix_(j, i)] for j, i in ((y, x), (y2, x), (y, x2), (y2, x2)))
    mixed = ((own + row + column + across + 8 + 2 * (row + column) >> 3) + own) >> 1
    return np.where(side[None, :], (3 * own + row + 2) >> 2, mixed)


def full_size(planes: DataFrame, *names: str) -> DataFrame:
    """Half-size planes at the size that width and height say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[bytes]] = {n: [] for n in names}
            for i in range(len(batch)):
                w, h = batch.column("width")[i].as_py(), batch.column("height")[i].as_py()
                for n in names:
                    small = np.frombuffer(batch.column(n)[i].as_py(), np.uint8).reshape((h + 1) // 2, (w + 1) // 2)
                    out[n].append(up_sampled(small, w, h).astype(np.uint8).tobytes() if w and h else b"")
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.binary()) if c in out else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return planes.mapInArrow(run, planes.schema)
