"""Colour math on channel columns (INT, 0-255) and packed ARGB columns.

Everything is a JVM-side expression.  Where results depend on single-precision
arithmetic every operand is cast to FLOAT, because Spark would otherwise widen
mixed arithmetic to DOUBLE.  Rounding is floor(x + 0.5).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Argb(NamedTuple):
    """Alpha, red, green and blue columns."""

    a: Column
    r: Column
    g: Column
    b: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Argb:
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in "argb"))

    @classmethod
    def unpacked(cls, argb: Column) -> Argb:
        return cls(alpha(argb), red(argb), green(argb), blue(argb))

    @classmethod
    def literal(cls, argb: int) -> Argb:
        return cls(*(F.lit(argb >> s & 255) for s in (24, 16, 8, 0)))

    def packed(self) -> Column:
        return pack(self.a, self.r, self.g, self.b)

    def named(self) -> list[Column]:
        return [c.cast("int").alias(n) for c, n in zip(self, "argb")]

    def rgb(self, f) -> Argb:
        """The same alpha, f of the other channels."""
        return Argb(self.a, f(self.r), f(self.g), f(self.b))


def when(condition: Column, then: Argb, otherwise: Argb) -> Argb:
    return Argb(*(F.when(condition, x).otherwise(y) for x, y in zip(then, otherwise)))


def f32(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def rounded(x: Column) -> Column:
    return F.floor(x.cast("double") + 0.5).cast("int")


def clamp(x: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def idiv(x: Column, y: Column | int) -> Column:
    """Integer quotient, truncated."""
    y = y if isinstance(y, Column) else F.lit(y)
    return F.call_function("div", x, y).cast("int")


def div255(x: Column) -> Column:
    return idiv(x + 127, 255)


# -- packing -----------------------------------------------------------------


def alpha(argb: Column) -> Column:
    return F.shiftrightunsigned(argb, 24).bitwiseAND(F.lit(255))


def red(argb: Column) -> Column:
    return F.shiftrightunsigned(argb, 16).bitwiseAND(F.lit(255))


def green(argb: Column) -> Column:
    return F.shiftrightunsigned(argb, 8).bitwiseAND(F.lit(255))


def blue(argb: Column) -> Column:
    return argb.bitwiseAND(F.lit(255))


def pack(a: Column, r: Column, g: Column, b: Column) -> Column:
    """Signed 32-bit 0xAARRGGBB; channels are taken modulo 256."""
    low = (c.cast("int").bitwiseAND(F.lit(255)) for c in (a, r, g, b))
    return reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(c, s) for c, s in zip(low, (24, 16, 8, 0))))


def unsigned(argb: Column) -> Column:
    return argb.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))


def with_alpha(argb: Column, a: Column) -> Column:
    return argb.bitwiseAND(F.lit(0xFFFFFF)).bitwiseOR(F.shiftleft(a.cast("int").bitwiseAND(F.lit(255)), 24))


# -- single colours ------------------------------------------------------------


def hsv(hue: Column, saturation: Column, value: Column, a: Column | int = 255) -> Argb:
    """Hue in degrees, wrapped; saturation and value 0-1."""
    h = (((f32(hue) % f32(360)) + f32(360)) % f32(360)) / f32(60)
    h = h.cast("float")
    c = (f32(value) * f32(saturation)).cast("float")
    x = (c * (f32(1) - F.abs((h % f32(2)) - f32(1)))).cast("float")
    m = (f32(value) - c).cast("float")
    sector, zero = F.floor(h), f32(0)

    def channel(*at: Column) -> Column:
        picked = reduce(lambda acc, i: acc.when(sector == i, at[min(i, 5)]), range(1, 7), F.when(sector == 0, at[0]))
        return rounded(((picked + m) * f32(255)).cast("float"))

    a = a if isinstance(a, Column) else F.lit(a)
    return Argb(a, channel(c, x, zero, zero, x, c), channel(x, c, c, x, zero, zero), channel(zero, zero, x, c, c, x))


def plain_luma(p: Argb) -> Column:
    """Rec. 601 in single precision, alpha ignored, red first times its weight."""
    return (f32(0.299) * f32(p.r) + f32(0.587) * f32(p.g) + f32(0.114) * f32(p.b)).cast("float")


def luma(p: Argb) -> Column:
    """Rec. 601 in single precision times alpha / 255."""
    return (plain_luma(p) * (f32(p.a) / f32(255)).cast("float")).cast("float")


def print_luma(p: Argb) -> Column:
    """Integer thousandths, rounded: the one of the portable any-map writer."""
    return idiv(p.r * 299 + p.g * 587 + p.b * 114 + 500, 1000)


def quick_luma(p: Argb) -> Column:
    """(r + 2g + b) / 4: the one of the segment analysis."""
    return F.shiftright(p.r + p.g * 2 + p.b, 2)


def grayscale(p: Argb) -> Argb:
    y = clamp(rounded(plain_luma(p)))
    return Argb(p.a, y, y, y)


def invert(p: Argb) -> Argb:
    return p.rgb(lambda c: c.bitwiseXOR(F.lit(255)))


def multiply_alpha(p: Argb, factor: float) -> Argb:
    factor = min(1.0, max(0.0, factor))
    return p if factor == 1.0 else p._replace(a=rounded((f32(p.a) * f32(factor)).cast("float")))


def premultiply(p: Argb) -> Argb:
    out = p.rgb(lambda c: div255(c * p.a))
    return when(p.a == 255, p, when(p.a == 0, Argb(*[F.lit(0)] * 4), out))


def unpremultiply(p: Argb) -> Argb:
    out = p.rgb(lambda c: F.least(F.lit(255), idiv(c * 255, F.greatest(p.a, F.lit(1)))))
    return when((p.a == 255) | (p.a == 0), p, out)


def tint(p: Argb, argb: int) -> Argb:
    t = Argb.literal(argb)
    return when(p.a == 0, p, Argb(p.a, div255(p.r * t.r), div255(p.g * t.g), div255(p.b * t.b)))


# -- two colours -----------------------------------------------------------------


def blend_normal(s: Argb, d: Argb) -> Argb:
    sa = (f32(s.a) / f32(255)).cast("float")
    rest = (f32(1) - sa).cast("float")
    mix = Argb(rounded((f32(s.a) + f32(d.a) * rest).cast("float")), *(rounded((f32(x) * sa + f32(y) * rest).cast("float")) for x, y in zip(s[1:], d[1:])))
    return when(s.a == 255, s, when(s.a == 0, d, mix))


def blend_add(s: Argb, d: Argb) -> Argb:
    sa = (f32(s.a) / f32(255)).cast("float")
    top = F.lit(255)
    out = Argb(F.least(top, d.a + s.a), *(F.least(top, y + rounded((f32(x) * sa).cast("float"))) for x, y in zip(s[1:], d[1:])))
    return when(s.a == 0, d, out)


def blend_multiply(s: Argb, d: Argb) -> Argb:
    return when(s.a == 0, d, Argb(d.a, *(div255(x * y) for x, y in zip(s[1:], d[1:]))))


def _overlay(s: Column, d: Column) -> Column:
    return F.when(d < 128, div255(s * d * 2)).otherwise(F.lit(255) - div255((F.lit(255) - s) * (F.lit(255) - d) * 2))


def blend_overlay(s: Argb, d: Argb) -> Argb:
    return when(s.a == 0, d, Argb(d.a, *(_overlay(x, y) for x, y in zip(s[1:], d[1:]))))


def blend_quadratic_add(s: Argb, d: Argb) -> Argb:
    return when(s.a == 0, d, Argb(d.a, *(F.least(F.lit(255), div255(x * x) + y) for x, y in zip(s[1:], d[1:]))))


BLENDS = {
    "normal": blend_normal,
    "replace": lambda s, d: s,
    "add": blend_add,
    "multiply": blend_multiply,
    "overlay": blend_overlay,
    "quadratic_add": blend_quadratic_add,
}


def blend(s: Argb, d: Argb, mode: str = "normal") -> Argb:
    if mode not in BLENDS:
        raise ValueError(f"no blend mode {mode}")
    return BLENDS[mode](s, d)


def lerp(p: Argb, q: Argb, share: float | Column) -> Argb:
    """Channel-wise mix; share 0 is p, 1 is q."""
    t = f32(share) if isinstance(share, Column) else f32(min(1.0, max(0.0, share)))
    rest = (f32(1) - t).cast("float")
    return Argb(*(rounded(F.least(f32(255), F.greatest(f32(0), (f32(x) * rest + f32(y) * t).cast("float")))) for x, y in zip(p, q)))


def flatten(p: Argb, background: int, transparent: bool, threshold: int = 128) -> Argb:
    """Opaque colours over a background, truncating; below the threshold clear, if there is a transparent slot."""
    bg = Argb.literal(background)
    mixed = Argb(F.lit(255), *(idiv(x * p.a + y * (F.lit(255) - p.a), 255) for x, y in zip(p[1:], bg[1:])))
    out = when(p.a >= 255, p, mixed)
    return when(p.a < threshold, Argb(*[F.lit(0)] * 4), out) if transparent else out


def over_white(c: Column, a: Column) -> Column:
    return idiv(c * a + (F.lit(255) - a) * 255 + 127, 255)


def over(s: Argb, d: Argb) -> Argb:
    """Straight-alpha "over", truncating, divided by the alpha that comes out."""
    keep = idiv(d.a * (F.lit(255) - s.a), 255)
    a = s.a + keep
    safe = F.greatest(a, F.lit(1))
    out = Argb(a, *(idiv(x * s.a + idiv(y * d.a * (F.lit(255) - s.a), 255), safe) for x, y in zip(s[1:], d[1:])))
    return when(s.a == 255, s, when(s.a == 0, d, out))


# -- other spaces ------------------------------------------------------------------


def to_ycbcr(p: Argb) -> tuple[Column, Column, Column]:
    """BT.601 fixed point."""
    y = F.shiftright(p.r * 66 + p.g * 129 + p.b * 25 + 128, 8) + 16
    cb = F.shiftright(p.b * 112 - p.r * 38 - p.g * 74 + 128, 8) + 128
    cr = F.shiftright(p.r * 112 - p.g * 94 - p.b * 18 + 128, 8) + 128
    return clamp(y), clamp(cb), clamp(cr)


def from_ycbcr(y: Column, cb: Column, cr: Column) -> Argb:
    yy, u, v = y - 16, cb - 128, cr - 128
    r = clamp(F.shiftright(yy * 298 + v * 409 + 128, 8))
    g = clamp(F.shiftright(yy * 298 - u * 100 - v * 208 + 128, 8))
    b = clamp(F.shiftright(yy * 298 + u * 516 + 128, 8))
    return Argb(F.lit(255), r, g, b)


def subtract_green(p: Argb) -> Argb:
    return p._replace(r=(p.r - p.g + 256) % 256, b=(p.b - p.g + 256) % 256)


def add_green(p: Argb) -> Argb:
    return p._replace(r=(p.r + p.g) % 256, b=(p.b + p.g) % 256)


def signed_byte(c: Column) -> Column:
    return F.when(c > 127, c - 256).otherwise(c)


def color_delta(t: Column, c: Column) -> Column:
    """(t * c) >> 5 of two signed bytes."""
    return F.shiftright(t * c, 5)


def color_transform(p: Argb, green_to_red: int, green_to_blue: int, red_to_blue: int, inverse: bool = False) -> Argb:
    g, sign = signed_byte(p.g), 1 if inverse else -1
    r = (p.r + color_delta(F.lit(green_to_red), g) * sign + 512) % 256
    source = signed_byte(r if inverse else p.r)
    b = (p.b + (color_delta(F.lit(green_to_blue), g) + color_delta(F.lit(red_to_blue), source)) * sign + 1024) % 256
    return p._replace(r=r, b=b)


def snap(c: Column, bits: int) -> Column:
    """Nearest multiple of 2^bits, ties by the bit above."""
    mask = (1 << bits) - 1
    biased = c + (mask >> 1) + F.shiftright(c, bits).bitwiseAND(F.lit(1))
    return F.when(biased > 255, F.lit(255)).otherwise(biased - biased % (1 << bits))


def cache_slot(argb: Column, bits: int) -> Column:
    """Multiplicative hash of a packed colour into 2^bits slots."""
    product = (unsigned(argb) * F.lit(0x1E35A7BD)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned(product, 32 - bits).cast("int")


def prefix_code(value: Column) -> tuple[Column, Column, Column]:
    """(symbol, extra bits, extra value) of a length or distance from 1 up."""
    v = value - 1
    high = F.length(F.bin(F.greatest(v, F.lit(4)))) - 1  # place of the highest bit; the smallest values have no use for it
    extra = high - 1
    second = F.call_function("shiftright", v, extra).bitwiseAND(F.lit(1))
    small, none = value < 5, F.lit(0)
    rest = v - F.call_function("shiftleft", F.call_function("shiftright", v, extra), extra)
    return F.when(small, v).otherwise(high * 2 + second), F.when(small, none).otherwise(extra), F.when(small, none).otherwise(rest)


def scale_sample(s: Column, most: Column | int) -> Column:
    most = most if isinstance(most, Column) else F.lit(most)
    return F.least(F.lit(255), idiv(s * 255, most))


def quality_index(quality: Column) -> Column:
    """Quantiser index 0-127 of a quality 0-1."""
    return clamp(((f32(1) - f32(quality)) * f32(127) + f32(0.5)).cast("int"), 0, 127)
