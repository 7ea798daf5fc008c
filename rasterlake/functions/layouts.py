"""Packed and banded sample layouts as colour channels; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import Argb


def _byte(value: Column, k: int) -> Column:
    """Byte k of a whole number, the lowest being 0."""
    return F.shiftright(value.cast("bigint"), 8 * k).bitwiseAND(F.lit(255)).cast("int")


def _packed(value: Column, order: str) -> Argb:
    """Channels of a whole number that holds them in this order, highest byte first; those not named are opaque."""
    at = {c: len(order) - 1 - k for k, c in enumerate(order)}
    return Argb(*(_byte(value, at[c]) if c in at else F.lit(255) for c in "argb"))


def _banded(content: Column, place: Column, order: str) -> Argb:
    """Channels of the pixel at ``place`` in bytes that hold each pixel's in this order; past the end they are null."""

    def band(k: int) -> Column:
        byte = F.substring(content, place.cast("int") * len(order) + (k + 1), F.lit(1))
        return F.when(F.octet_length(byte) == 1, F.conv(F.hex(byte), 16, 10).cast("int"))

    at = {c: k for k, c in enumerate(order)}
    return Argb(*(band(at[c]) if c in at else F.lit(255) for c in "argb"))


def int_rgb(value: Column) -> Argb:
    return _packed(value, "rgb")


def int_bgr(value: Column) -> Argb:
    return _packed(value, "bgr")


def bytes_abgr(content: Column, place: Column) -> Argb:
    return _banded(content, place, "abgr")


def bytes_bgr(content: Column, place: Column) -> Argb:
    return _banded(content, place, "bgr")


def indexed(index: Column, palette: Column) -> Argb:
    """``palette`` is an array of packed colours of at most 256 entries; an index beyond it is null in all channels."""
    return _packed(F.get(palette, _byte(index, 0)), "argb")


def gray(sample: Column, alpha: Column | None = None) -> Argb:
    v = _byte(sample, 0)
    return Argb(F.lit(255) if alpha is None else _byte(alpha, 0), v, v, v)
