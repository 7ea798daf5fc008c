"""Pictures in memory: what codecs read and write."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DISPOSALS = ("NONE", "DO_NOT_DISPOSE", "RESTORE_TO_BACKGROUND", "RESTORE_TO_PREVIOUS")
BLENDS = ("SOURCE", "OVER")


class RasterError(Exception):
    """Base of all errors of this package's sources and sinks."""


class DecodeError(RasterError):
    pass


class EncodeError(RasterError):
    pass


class UnsupportedFormat(RasterError):
    pass


@dataclass
class Frame:
    """Packed colours (height, width) uint32, with place and time."""

    argb: np.ndarray
    delay_ms: int = 0
    x: int = 0
    y: int = 0
    disposal: str = "NONE"
    blend: str = "SOURCE"

    @property
    def width(self) -> int:
        return self.argb.shape[1]

    @property
    def height(self) -> int:
        return self.argb.shape[0]


@dataclass
class Picture:
    frames: list[Frame]
    has_alpha: bool = True
    loop_count: int = 0
    background: int = 0
    width: int = field(default=-1)
    height: int = field(default=-1)

    def __post_init__(self) -> None:
        if not self.frames:
            raise RasterError("a picture has at least one frame")
        self.width = self.frames[0].width if self.width < 0 else self.width
        self.height = self.frames[0].height if self.height < 0 else self.height

    @property
    def first(self) -> np.ndarray:
        return self.frames[0].argb


def channels(argb: np.ndarray) -> np.ndarray:
    """(h, w) packed -> (h, w, 4) uint8 in the order r, g, b, a."""
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], axis=-1).astype(np.uint8)


def packed(rgba: np.ndarray) -> np.ndarray:
    """(..., 3 or 4) r, g, b and perhaps a -> packed; without a opaque."""
    p = rgba.astype(np.uint32)
    a = p[..., 3] if p.shape[-1] == 4 else np.uint32(255)
    return (a << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]).astype(np.uint32)
