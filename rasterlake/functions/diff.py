"""Visual differences of two colours; each gives the colour of the difference picture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import Argb, clamp, f32, idiv, over_white, plain_luma, when

#: Colours of the difference pictures.
MAGENTA, CYAN, BOTH, MATCH = 0xFFFF00FF, 0xFF00FFFF, 0xFF303034, 0xFF101010


def _one_clear(p: Argb, q: Argb) -> Column:
    return (p.a == 0) != (q.a == 0)


def _covered(p: Argb, q: Argb, out: Argb) -> Argb:
    """Clear where both are, magenta where one is."""
    return when((p.a == 0) & (q.a == 0), Argb.literal(0), when(_one_clear(p, q), Argb.literal(MAGENTA), out))


def _amplified(deltas: list[Column]) -> Argb:
    return Argb(F.lit(255), *(F.least(F.lit(255), d * 4) for d in deltas))


def absolute(p: Argb, q: Argb) -> Argb:
    deltas = [F.abs(x - y) for x, y in zip(p, q)]
    same = (deltas[0] == 0) & (deltas[1] == 0) & (deltas[2] == 0) & (deltas[3] == 0)
    return _covered(p, q, when(same, Argb.literal(MATCH), _amplified(deltas[1:])))


def on_white(p: Argb, q: Argb) -> Argb:
    deltas = [F.abs(over_white(x, p.a) - over_white(y, q.a)) for x, y in zip(p[1:], q[1:])]
    same = (deltas[0] == 0) & (deltas[1] == 0) & (deltas[2] == 0)
    return when(same, Argb.literal(0), when(_one_clear(p, q), Argb.literal(MAGENTA), _amplified(deltas)))


def signed_luma(p: Argb, q: Argb) -> Argb:
    delta = (plain_luma(p) - plain_luma(q)).cast("float")
    size = F.least(f32(127), (F.abs(delta) * f32(2)).cast("float")).cast("int")
    up, down = F.lit(128) + size, F.lit(128) - idiv(size, 2)
    rising = delta >= 0
    return _covered(p, q, Argb(F.lit(255), F.when(rising, up).otherwise(down), down, F.when(rising, down).otherwise(up)))


def signed_rgb(p: Argb, q: Argb) -> Argb:
    return _covered(p, q, Argb(F.lit(255), *(clamp((x - y) * 2 + 128) for x, y in zip(p[1:], q[1:]))))


def coverage(p: Argb, q: Argb) -> Argb:
    """Missing pixels are clear: meant for a full outer join."""
    pa, qa = F.coalesce(p.a, F.lit(0)), F.coalesce(q.a, F.lit(0))
    one = when(pa > 0, Argb.literal(MAGENTA), Argb.literal(CYAN))
    return when((pa == 0) & (qa == 0), Argb.literal(0), when((pa > 0) & (qa > 0), Argb.literal(BOTH), one))


DIFFS = {"absolute": absolute, "over_white": on_white, "signed_luma": signed_luma, "signed_rgb": signed_rgb, "coverage": coverage}
