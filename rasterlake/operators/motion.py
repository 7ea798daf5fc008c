"""Motion between frames: block matching with successive elimination, and the vote of neighbouring vectors.

``planes`` rows (picture_id, frame_idx, width, height, luma, and cb, cr if chroma counts)
meet their predecessors by an equi-join on (animation, frame number).  A block of a frame
is looked for in the frame before it.  The sum of absolute differences of two blocks is at
least the sum of differences of their sub-blocks' sums, and those sums of the whole frame
before are tables made once; so offsets are taken in rising order of that bound, and all
whose bound is above the best found are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planes import sub_sample

#: Blocks of a split, as (columns, rows) of the macroblock: halves, quarters, sixteenths.
SPLITS = ((1, 2), (2, 1), (2, 2), (4, 4))
_KEYS = "picture_id bigint, frame_idx int, tx int, ty int"
_FOUND = _KEYS + ", split int, slot int, mv_row int, mv_col int, sad bigint, sse bigint, offsets int, compared int"
_AT_ONCE = 32


def _padded(plane: np.ndarray, size: int) -> np.ndarray:
    return np.pad(plane, [(0, -n % size) for n in plane.shape], mode="edge")


class Reference:
    """The frame before, with sums of its windows by their size."""

    def __init__(self, luma: np.ndarray, chroma: list[np.ndarray]):
        self.luma, self.chroma = luma.astype(np.int32), chroma
        self.total = np.zeros((luma.shape[0] + 1, luma.shape[1] + 1), np.int64)
        self.total[1:, 1:] = luma.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
        self._sums: dict[tuple[int, int], np.ndarray] = {}

    def sums(self, w: int, h: int) -> np.ndarray:
        """Sums of all w by h windows, by their first row and column."""
        if (w, h) not in self._sums:
            t = self.total
            self._sums[w, h] = t[h:, w:] - t[:-h, w:] - t[h:, :-w] + t[:-h, :-w]
        return self._sums[w, h]


def best_offset(block: np.ndarray, ref: Reference, x: int, y: int, radius: int) -> tuple[int, int, int, int, int]:
    """(dx, dy, sad, offsets, compared) of the best match: the offset zero first, then row by row, the first of equals."""
    h, w = block.shape
    y0, y1 = max(0, y - radius), min(ref.luma.shape[0] - h, y + radius)
    x0, x1 = max(0, x - radius), min(ref.luma.shape[1] - w, x + radius)
    pw, ph = max(1, w // 4), max(1, h // 4)
    sums = ref.sums(pw, ph)
    bound = np.zeros((y1 - y0 + 1, x1 - x0 + 1), np.int64)
    for j in range(0, h, ph):
        for i in range(0, w, pw):
            bound += np.abs(sums[y0 + j : y1 + j + 1, x0 + i : x1 + i + 1] - int(block[j : j + ph, i : i + pw].sum()))
    zero = (y - y0) * bound.shape[1] + (x - x0)
    scan = np.arange(1, bound.size + 1)
    scan[zero] = 0
    best, place = int(np.abs(ref.luma[y : y + h, x : x + w] - block).sum()), 0
    flat = bound.ravel()
    order = np.flatnonzero(flat <= best)
    order = order[order != zero]
    order = order[np.argsort(flat[order], kind="stable")]
    windows = np.lib.stride_tricks.sliding_window_view(ref.luma, (h, w))
    compared, at = 1, zero
    for k in range(0, len(order), _AT_ONCE):
        some = order[k : k + _AT_ONCE]
        some = some[flat[some] <= best]
        if not len(some):
            break
        compared += len(some)
        sads = np.abs(windows[y0 + some // bound.shape[1], x0 + some % bound.shape[1]] - block).sum(axis=(1, 2))
        i = np.lexsort((scan[some], sads))[0]
        if (int(sads[i]), int(scan[some[i]])) < (best, place):
            best, place, at = int(sads[i]), int(scan[some[i]]), int(some[i])
    return x0 + at % bound.shape[1] - x, y0 + at // bound.shape[1] - y, best, bound.size, compared


def _squared(block: np.ndarray, chroma: list[np.ndarray], ref: Reference, x: int, y: int, row: int, col: int) -> int:
    """Squared error of the prediction at a vector in quarter samples; chroma vectors are halves, rounded away from zero."""
    h, w = block.shape
    error = int(((block - sub_sample(ref.luma, x + (col >> 2), y + (row >> 2), w, h, (col & 3) * 2, (row & 3) * 2)) ** 2).sum())
    half = lambda v: (abs(2 * v) + 1) // 2 * (1 if v >= 0 else -1)
    for own, plane in zip(chroma, ref.chroma):
        r, c = half(row), half(col)
        error += int(((own - sub_sample(plane, x // 2 + (c >> 3), y // 2 + (r >> 3), w // 2, h // 2, c & 7, r & 7)) ** 2).sum())
    return error


def refined(block: np.ndarray, chroma: list[np.ndarray], ref: Reference, x: int, y: int, dx: int, dy: int) -> tuple[int, int, int]:
    """(row, column, squared error) in quarter samples: halves around the whole offset, then quarters if a half was better."""
    row, col = 4 * dy, 4 * dx
    best = (_squared(block, chroma, ref, x, y, row, col), row, col)
    for step in (2, 1):
        _, row, col = best
        for r in (-step, 0, step):
            for c in (-step, 0, step):
                if r or c:
                    error = _squared(block, chroma, ref, x, y, row + r, col + c)
                    if error < best[0]:
                        best = (error, row + r, col + c)
        if best[1:] == (row, col):
            break
    return best[1], best[2], best[0]


def _frame(luma: np.ndarray, chroma: list[np.ndarray], ref: Reference, size: int, radius: int, fine: bool, gate: int | None) -> Iterator[tuple]:
    for ty in range(luma.shape[0] // size):
        for tx in range(luma.shape[1] // size):
            x, y = tx * size, ty * size
            block = luma[y : y + size, x : x + size]
            own = [c[y // 2 : (y + size) // 2, x // 2 : (x + size) // 2] for c in chroma]
            dx, dy, sad, offsets, compared = best_offset(block, ref, x, y, radius)
            row, col, sse = refined(block, own, ref, x, y, dx, dy) if fine else (4 * dy, 4 * dx, None)
            yield tx, ty, None, 0, row, col, sad, sse, offsets, compared
            if fine and gate is not None and sse >= gate:
                for split, (across, down) in enumerate(SPLITS):
                    w, h = size // across, size // down
                    for slot in range(across * down):
                        i, j = slot % across * w, slot // across * h
                        part = block[j : j + h, i : i + w]
                        dx, dy, sad, offsets, compared = best_offset(part, ref, x + i, y + j, radius)
                        row, col, error = refined(part, [], ref, x + i, y + j, dx, dy)
                        yield tx, ty, split, slot, row, col, sad, error, offsets, compared


def vectors(planes: DataFrame, size: int = 16, radius: int = 16, fine: bool = True, gate: int | None = 16_384) -> DataFrame:
    """Each block's vector (quarter samples) into the frame before, with sad, sse, offsets in reach and offsets compared.

    Frames are filled up to whole blocks by repeating their edges.  A frame without a
    predecessor of its size has no rows.  ``fine`` refines to halves and quarters by
    squared error, of all planes for whole blocks and of luma for parts.  Blocks whose
    error is ``gate`` or more get vectors for their halves, quarters and sixteenths too
    (``split`` 0 to 3; null for whole blocks).  Repeated (picture_id, frame_idx) rows meet each
    of their predecessors.
    """
    names = [n for n in ("luma", "cb", "cr") if n in planes.columns]
    now = planes.select("picture_id", "frame_idx", "width", "height", *names)
    before = now.select("picture_id", (F.col("frame_idx") + 1).alias("frame_idx"), "width", "height", *(F.col(n).alias(f"{n}_0") for n in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if not r["width"] or not r["height"]:
                    continue
                plane = lambda n: _padded(np.frombuffer(r[n], np.uint8).reshape(r["height"] if n.startswith("luma") else (r["height"] + 1) // 2, -1), size if n.startswith("luma") else size // 2)  # noqa: B023, E731
                ref = Reference(plane("luma_0"), [plane(f"{n}_0") for n in names[1:]])
                rows = [(r["picture_id"], r["frame_idx"], *v) for v in _frame(plane("luma").astype(np.int32), [plane(n).astype(np.int32) for n in names[1:]], ref, size, radius, fine, gate)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), *[pa.int32()] * 7, pa.int64(), pa.int64(), pa.int32(), pa.int32()])], names=[c.split()[0] for c in _FOUND.split(", ")])

    return now.join(before, ["picture_id", "frame_idx", "width", "height"]).mapInArrow(run, _FOUND)


def neighbour_vote(blocks: DataFrame, golden_bias: bool = False, other_bias: bool = False) -> DataFrame:
    """Nearest, near and best vectors of each block from three neighbours, and the votes they had.

    ``blocks`` rows are (picture_id, frame_idx, tx, ty, mv_row, mv_col, ref): ref 0 is no
    reference frame, 1 the last, 2 the golden, 3 the alternate one.  The blocks above and to the left
    have two votes each, the one above left has one.  A neighbour whose reference frame has the other
    sign bias counts with its vector turned round.  Walking above, left, above left, a
    vector other than zero and other than the one before it opens a slot; zero vectors
    vote for slot 0.  If all three opened slots and the last equals the first, the first
    gets a vote more.  The two first slots are exchanged if the second has more votes,
    and the first is best if it has no fewer votes than zero.
    """
    ref = F.col("ref")
    bias = (F.lit(golden_bias) & (ref == 2)) | (F.lit(other_bias) & (ref == 3))
    own = blocks.select("picture_id", "frame_idx", "tx", "ty", "mv_row", "mv_col", "ref", bias.alias("bias"))
    out = own
    at = ["picture_id", "frame_idx", "tx", "ty"]
    for n, (dx, dy) in {"a": (0, 1), "l": (1, 0), "c": (1, 1)}.items():
        seen = own.filter(F.col("ref") > 0).select("picture_id", "frame_idx", (F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"), *(F.col(c).alias(f"{n}_{c}") for c in ("mv_row", "mv_col", "bias")))
        out = out.join(seen, at, "left")
    out = out.select(*at, *(_turned(n).alias(n) for n in "alc"))
    # the slot that each neighbour votes for: 0 for zero vectors, null for none
    zero = F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"))
    moved = lambda v: v.isNotNull() & (v != zero)
    out = out.withColumn("s1", F.when(moved(F.col("a")), 1).when(F.col("a").isNotNull(), 0))
    out = out.withColumn("p1", F.coalesce("s1", F.lit(0))).withColumn("v1", F.when(F.col("p1") == 1, F.col("a")).otherwise(zero))
    for n, k in (("l", 2), ("c", 3)):
        v, p, last = F.col(n), F.col(f"p{k - 1}"), F.col(f"v{k - 1}")
        out = out.withColumn(f"s{k}", F.when(moved(v), F.when(v == last, p).otherwise(p + 1)).when(v.isNotNull(), 0))
        out = out.withColumn(f"p{k}", F.greatest(p, F.coalesce(f"s{k}", F.lit(0)))).withColumn(f"v{k}", F.when(moved(v), v).otherwise(last))
    votes = lambda slot: sum((F.when(F.col(f"s{k}") == slot, w).otherwise(0) for k, w in ((1, 2), (2, 2), (3, 1))), F.lit(0))
    of = lambda slot: F.coalesce(*(F.when(F.col(f"s{k}") == slot, F.col(n)) for k, n in ((1, "a"), (2, "l"), (3, "c"))), zero)
    again = (F.col("p3") == 3) & (F.col("c") == of(1))
    out = out.select(*at, votes(0).alias("n0"), (votes(1) + again.cast("int")).alias("n1"), votes(2).alias("n2"), of(1).alias("m1"), of(2).alias("m2"))
    swap = F.col("n2") > F.col("n1")
    out = out.select(*at, "n0", F.when(swap, F.col("n2")).otherwise(F.col("n1")).alias("n1"), F.when(swap, F.col("n1")).otherwise(F.col("n2")).alias("n2"), F.when(swap, F.col("m2")).otherwise(F.col("m1")).alias("m1"), F.when(swap, F.col("m1")).otherwise(F.col("m2")).alias("m2"))
    best = F.when(F.col("n1") >= F.col("n0"), F.col("m1")).otherwise(zero)
    pair = lambda v, name: (v["r"].alias(f"{name}_row"), v["c"].alias(f"{name}_col"))
    return out.select(*at, *pair(F.col("m1"), "nearest"), *pair(F.col("m2"), "near"), *pair(best, "best"), F.col("n0").alias("zero_votes"), F.col("n1").alias("nearest_votes"), F.col("n2").alias("near_votes"))


def _turned(n: str) -> Column:
    sign = F.when(F.col(f"{n}_bias") != F.col("bias"), -1).otherwise(1)
    return F.when(F.col(f"{n}_mv_row").isNotNull(), F.struct((F.col(f"{n}_mv_row") * sign).cast("int").alias("r"), (F.col(f"{n}_mv_col") * sign).cast("int").alias("c")))
