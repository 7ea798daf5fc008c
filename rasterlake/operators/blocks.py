"""4x4 integer transforms of the lossy format: blocks as arrays of 16 numbers, row by row.

Multipliers, rounding terms and shifts are the format's and the usual encoder's, since
results must be equal bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import idiv

#: The two rotations of the inverse transform, in 1/65536; those of the forward one, in 1/4096.
COSINE, SINE, FORWARD_SINE, FORWARD_COSINE = 20_091, 35_468, 2_217, 5_352

Line = Callable[[Column, Column, Column, Column], list[Column]]


def gathered(px: DataFrame, value: Column) -> DataFrame:
    """(picture_id, tx, ty, block) of each 4x4 square; a missing pixel is 0."""
    place = F.col("y") % 4 * 4 + F.col("x") % 4
    rows = px.select("picture_id", idiv(F.col("x"), 4).alias("tx"), idiv(F.col("y"), 4).alias("ty"), place.alias("place"), value.cast("int").alias("v"))
    cells = [F.coalesce(F.max(F.when(F.col("place") == k, F.col("v"))), F.lit(0)) for k in range(16)]
    return rows.groupBy("picture_id", "tx", "ty").agg(F.array(*cells).alias("block"))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _turned(block: Column) -> Column:
    return _bound(block, lambda b: F.array(*(b[k % 4 * 4 + k // 4] for k in range(16))))


def _rows(block: Column, line: Line) -> Column:
    def one(b: Column) -> Column:
        return F.flatten(F.transform(F.array(*(F.slice(b, i * 4 + 1, 4) for i in range(4))), lambda v: F.array(*line(*(v[k] for k in range(4))))))

    return _bound(block, one)


def _columns(block: Column, line: Line) -> Column:
    return _turned(_rows(_turned(block), line))


def forward_dct(block: Column) -> Column:
    def line(scaled: Callable[[Column], Column], shift: int, second: int, last: int, bump: bool) -> Line:
        def run(p: Column, q: Column, r: Column, s: Column) -> list[Column]:
            outer, inner = p - s, q - r
            one = F.shiftright(inner * FORWARD_SINE + outer * FORWARD_COSINE + second, shift)
            three = F.shiftright(outer * FORWARD_SINE - inner * FORWARD_COSINE + last, shift)
            return [scaled(p + s + q + r), one + (outer != 0).cast("int") if bump else one, scaled(p + s - q - r), three]

        return run

    across = _rows(block, line(lambda v: v * 8, 9, 1812, 937, False))
    return _columns(across, line(lambda v: F.shiftright(v + 7, 4), 16, 12_000, 51_000, True))


def inverse_dct(block: Column) -> Column:
    def more(v: Column) -> Column:
        return F.shiftright(v * COSINE, 16) + v

    def less(v: Column) -> Column:
        return F.shiftright(v * SINE, 16)

    def line(p: Column, q: Column, r: Column, s: Column) -> list[Column]:
        even, odd = (p + r, p - r), (more(q) + less(s), less(q) - more(s))
        return [even[0] + odd[0], even[1] + odd[1], even[1] - odd[1], even[0] - odd[0]]

    return _rows(_columns(block, line), lambda p, *rest: [F.shiftright(v, 3) for v in line(p + 4, *rest)])


def _hadamard(p: Column, q: Column, r: Column, s: Column) -> list[Column]:
    return [p + q + r + s, p + q - r - s, p - q - r + s, p - q + r - s]


def forward_wht(block: Column) -> Column:
    return _columns(_rows(block, _hadamard), lambda *v: [F.shiftright(x, 1) for x in _hadamard(*v)])


def inverse_wht(block: Column) -> Column:
    return _rows(_columns(block, _hadamard), lambda p, *rest: [F.shiftright(x, 3) for x in _hadamard(p + 3, *rest)])
