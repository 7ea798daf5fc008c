"""Filters that look at neighbours: near-lossless snapping, spatial prediction, edge smoothing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.color import snap


def _row() -> WindowSpec:
    return Window.partitionBy("picture_id", "y").orderBy("x")


def _column() -> WindowSpec:
    return Window.partitionBy("picture_id", "x").orderBy("y")


def _neighbours(px: DataFrame, **at: tuple) -> DataFrame:
    """Columns <name>_<channel> of neighbours given as (window, function)."""
    return px.withColumns({f"{n}_{c}": f(c).over(w) for n, (w, f) in at.items() for c in "argb"})


def _by_picture(px: DataFrame) -> DataFrame:
    """Dealt out by picture: windows over its rows and over its columns then need no shuffle of their own."""
    return px.repartition(F.col("picture_id"))


def near_lossless_pass(px: DataFrame, bits: int, width: int, height: int) -> DataFrame:
    """Colours snapped where they differ from a neighbour by 2^bits or more; one shuffle, also for several passes in a row."""
    return _snapped(_by_picture(px), bits, width, height)


def _snapped(px: DataFrame, bits: int, width: int, height: int) -> DataFrame:
    limit = 1 << bits
    rows = _neighbours(px, left=(_row(), F.lag), right=(_row(), F.lead))
    rows = _neighbours(rows, up=(_column(), F.lag), down=(_column(), F.lead))
    smooth = F.lit(True)
    for n in ("left", "right", "up", "down"):
        for c in "argb":
            smooth = smooth & (F.abs(F.col(c) - F.col(f"{n}_{c}")) < limit)
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
    keep = border | F.coalesce(smooth, F.lit(False))
    return rows.select("picture_id", "x", "y", *(F.when(keep, F.col(c)).otherwise(snap(F.col(c), bits)).cast("int").alias(c) for c in "argb"))


def near_lossless(px: DataFrame, level: int, width: int, height: int, least: int = 64) -> DataFrame:
    """Snap colours in busy places to fewer levels; level 100 keeps all, smaller levels lose up to 5 bits."""
    bits = 5 - max(0, level) // 20
    if level >= 100 or bits <= 0 or (width < least and height < least) or height < 3:
        return px
    px = _by_picture(px)
    for b in range(bits, 0, -1):
        px = _snapped(px, b, width, height)
    return px


def _half(p: Column, q: Column) -> Column:
    """Mean of two channels, rounded down."""
    return F.shiftright(p + q, 1)


def _surrounded(px: DataFrame) -> DataFrame:
    """Columns <name>_<channel> of left, top, top left, top right and the own row's first pixel."""
    rows = _neighbours(_by_picture(px), l=(_row(), F.lag))
    rows = _neighbours(rows, t=(_column(), F.lag))
    rows = rows.withColumns({f"f_{c}": F.first(c).over(_row()) for c in "argb"})
    rows = rows.withColumns({f"tl_{c}": F.lag(f"l_{c}").over(_column()) for c in "argb"})
    return rows.withColumns({f"tr_{c}": F.coalesce(F.lead(f"t_{c}").over(_row()), F.col(f"f_{c}")) for c in "argb"})


def predicted_residual(px: DataFrame, mode: int) -> DataFrame:
    """Difference, modulo 256, from a spatial prediction; the first row predicts from the left, the first column from above.

    Mode 0: opaque black.  Modes 1-4: left, top, top right, top left; 5-10: means of some of them, rounded
    down; 11: the one of left and top that is nearer to left + top - top left; 12:
    that sum, clamped; 13: the mean of left and top, moved half way from top left.
    The last column takes the top right from the first pixel of the own row, as the
    public format description does.
    """
    return _surrounded(px).select("picture_id", "x", "y", *(r.alias(c) for c, r in _residuals(mode).items()))


def _residuals(mode: int) -> dict[str, Column]:
    """The residual of each channel, over the columns of ``_surrounded``."""

    def n(name: str, c: str) -> Column:
        return F.col(f"{name}_{c}")

    if mode == 11:
        # distances of the sum from left and from top, over all channels
        to_left = sum((F.abs(n("t", c) - n("tl", c)) for c in "argb"), F.lit(0))
        to_top = sum((F.abs(n("l", c) - n("tl", c)) for c in "argb"), F.lit(0))

    def guess(c: str) -> Column:
        plain = {0: F.lit(255 if c == "a" else 0), 1: n("l", c), 2: n("t", c), 3: n("tr", c), 4: n("tl", c)}
        if mode in plain:
            return plain[mode]
        means = {5: ("l", "tr", "t"), 6: ("l", "tl"), 7: ("l", "t"), 8: ("tl", "t"), 9: ("t", "tr")}
        if mode in means:
            return reduce(_half, (n(k, c) for k in means[mode]))
        if mode == 10:
            return _half(_half(n("l", c), n("tl", c)), _half(n("t", c), n("tr", c)))
        if mode == 11:
            return F.when(to_left < to_top, n("l", c)).otherwise(n("t", c))
        if mode == 12:
            return F.least(F.lit(255), F.greatest(F.lit(0), n("l", c) + n("t", c) - n("tl", c)))
        if mode == 13:
            mean = _half(n("l", c), n("t", c))
            return F.least(F.lit(255), F.greatest(F.lit(0), mean + F.call_function("div", mean - n("tl", c), F.lit(2)).cast("int")))
        raise ValueError(f"no predictor {mode} here")

    first = {c: F.lit(255 if c == "a" else 0) for c in "argb"}
    out = {}
    for c in "argb":
        at = F.when((F.col("x") == 0) & (F.col("y") == 0), first[c]).when(F.col("y") == 0, n("l", c)).when(F.col("x") == 0, n("t", c)).otherwise(guess(c))
        out[c] = ((F.col(c) - at + 256) % 256).cast("int")
    return out


def predictor_scores(px: DataFrame, modes: tuple[int, ...], tile: int) -> DataFrame:
    """Sum of absolute signed residuals of each tile under each mode, and the mode with the least (the first of equals)."""
    rows = _surrounded(px)
    cost = {m: sum((F.abs(F.when(r > 127, r - 256).otherwise(r)) for r in _residuals(m).values()), F.lit(0)) for m in modes}
    rows = rows.select("picture_id", "x", "y", *(v.alias(f"c{m}") for m, v in cost.items()))
    tiles = rows.groupBy("picture_id", F.call_function("div", F.col("x"), F.lit(tile)).cast("int").alias("tx"), F.call_function("div", F.col("y"), F.lit(tile)).cast("int").alias("ty"))
    scores = tiles.agg(*(F.sum(f"c{m}").cast("bigint").alias(f"c{m}") for m in modes))
    best = F.array_min(F.array(*(F.struct(F.col(f"c{m}").alias("score"), F.lit(m).alias("mode")) for m in modes)))
    return scores.select("picture_id", "tx", "ty", best.alias("b")).select("picture_id", "tx", "ty", F.col("b.mode").alias("mode"), F.col("b.score").alias("score"))


# -- edge smoothing over dense frames ---------------------------------------------------


def _luma(p: np.ndarray) -> np.ndarray:
    f = np.float32
    return (p[..., 1] * f(0.299) + p[..., 2] * f(0.587) + p[..., 3] * f(0.114)) * (p[..., 0] / f(255))


def _sample(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, w = p.shape[:2]
    ix, iy = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - ix).astype(np.float32)[..., None], (y - iy).astype(np.float32)[..., None]
    ix, iy = np.clip(ix, 0, w - 2), np.clip(iy, 0, h - 2)
    one = np.float32(1)
    mix = p[iy, ix] * ((one - fx) * (one - fy)) + p[iy, ix + 1] * (fx * (one - fy)) + p[iy + 1, ix] * ((one - fx) * fy) + p[iy + 1, ix + 1] * (fx * fy)
    return np.clip(mix.astype(int), 0, 255)


def smooth_edges(argb: np.ndarray) -> np.ndarray:
    """Fast approximate anti-aliasing of (h, w, 4) channels a, r, g, b; border pixels stay."""
    f, p = np.float32, argb.astype(np.float32)
    if argb.shape[0] < 3 or argb.shape[1] < 3:
        return argb.copy()
    l = _luma(p)
    nw, ne, sw, se, m = l[:-2, :-2], l[:-2, 2:], l[2:, :-2], l[2:, 2:], l[1:-1, 1:-1]
    corners = np.stack([nw, ne, sw, se, m])
    low, high = corners.min(axis=0), corners.max(axis=0)
    sharp = high - low >= np.maximum(f(0.0156), high * f(0.0312))
    dx, dy = -((nw + ne) - (sw + se)), (nw + sw) - (ne + se)
    damp = np.maximum((nw + ne + sw + se) * f(0.0625), f(1 / 128))
    scale = f(1) / (np.minimum(np.abs(dx), np.abs(dy)) + damp)
    dx, dy = np.clip(dx * scale, f(-8), f(8)), np.clip(dy * scale, f(-8), f(8))
    y, x = np.mgrid[1 : argb.shape[0] - 1, 1 : argb.shape[1] - 1].astype(np.float32)
    a, b = (_sample(p, x + dx * k, y + dy * k) for k in (f(1 / 3) - f(0.5), f(2 / 3) - f(0.5)))
    alpha = (a[..., :1] + b[..., :1]) * f(0.5)
    color = (a[..., 1:] * a[..., :1] + b[..., 1:] * b[..., :1]).astype(np.float32) * f(0.5)
    safe = np.where(alpha > 0, alpha, 1)
    new = np.concatenate([alpha, color / safe], axis=2)
    new = np.where(alpha > 0, np.clip(new.astype(int), 0, 255), 0)
    out = argb.copy()
    out[1:-1, 1:-1] = np.where(sharp[..., None], new, out[1:-1, 1:-1])
    return out


def fxaa(frames: DataFrame) -> DataFrame:
    """Edge smoothing of (picture_id, width, height, argb array) rows."""
    columns = frames.columns

    def run(batches):
        for batch in batches:
            batch = batch.copy()
            batch["argb"] = [_packed(smooth_edges(_channels(p, w, h))) for p, w, h in zip(batch["argb"], batch["width"], batch["height"])]
            yield batch[columns]

    return frames.mapInPandas(run, frames.schema)


def _channels(argb: np.ndarray, w: int, h: int) -> np.ndarray:
    p = np.asarray(argb, np.int64).reshape(h, w) & 0xFFFFFFFF
    return np.stack([p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255], axis=2)


def _packed(p: np.ndarray) -> np.ndarray:
    p = p.astype(np.int64)
    return (p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]).astype(np.uint32).view(np.int32).ravel()


def resize_bicubic(frames: DataFrame, w: int, h: int) -> DataFrame:
    """Cubic convolution (a = -0.5) of dense frames; results are near those of common toolkits, not equal to any."""

    def run(batches):
        for batch in batches:
            rows = [(r.picture_id, w, h, _packed(_cubic(_channels(r.argb, r.width, r.height), w, h))) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["picture_id", "width", "height", "argb"])

    return frames.select("picture_id", "width", "height", "argb").mapInPandas(run, "picture_id bigint, width int, height int, argb array<int>")


def _cubic(p: np.ndarray, w: int, h: int) -> np.ndarray:
    """(rows, columns, 4) channels at another size, by cubic convolution."""

    def weights(size: int, was: int) -> np.ndarray:
        at = (np.arange(size) + 0.5) * was / size - 0.5
        base = np.floor(at).astype(int)
        out = np.zeros((size, was))
        for k in range(-1, 3):
            t = np.abs(at - (base + k))
            v = np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
            np.add.at(out, (np.arange(size), np.clip(base + k, 0, was - 1)), v)
        return out

    q = np.einsum("yj,jxc->yxc", weights(h, p.shape[0]), np.einsum("xi,jic->jxc", weights(w, p.shape[1]), p.astype(float)))
    return np.clip(np.floor(q + 0.5 + 1e-9), 0, 255)  # halves go up, however the sums were rounded


def normalize_frames(frames: DataFrame, fit: str = "contain", upscale: bool = False, width: int = 0, height: int = 0, background: int = 0) -> DataFrame:
    """Frames (picture_id, frame_idx, delay_ms, width, height, argb) drawn on one canvas size; offsets are gone."""
    from .timeline import fit_geometry

    geometry = fit_geometry(frames.select("picture_id", "frame_idx", "width", "height"), fit, upscale, width, height)
    rows = frames.select("picture_id", "frame_idx", "delay_ms", "width", "height", "argb").join(geometry, ["picture_id", "frame_idx"])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                p = _channels(r.argb, r.width, r.height)
                if not r.copied:
                    canvas = np.zeros((r.canvas_h, r.canvas_w, 4)) + np.array([background >> s & 255 for s in (24, 16, 8, 0)])
                    q = p if (r.draw_w, r.draw_h) == (r.width, r.height) else _cubic(p, r.draw_w, r.draw_h)
                    y0, x0 = max(0, r.draw_y), max(0, r.draw_x)
                    y1, x1 = min(r.canvas_h, r.draw_y + r.draw_h), min(r.canvas_w, r.draw_x + r.draw_w)
                    canvas[y0:y1, x0:x1] = q[y0 - r.draw_y : y1 - r.draw_y, x0 - r.draw_x : x1 - r.draw_x]
                    p = canvas
                out.append((r.picture_id, r.frame_idx, r.delay_ms, r.canvas_w, r.canvas_h, _packed(p)))
            yield pd.DataFrame(out, columns=["picture_id", "frame_idx", "delay_ms", "width", "height", "argb"])

    return rows.mapInPandas(run, "picture_id bigint, frame_idx int, delay_ms int, width int, height int, argb array<int>")
