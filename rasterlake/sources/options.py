"""Write options by format: immutable, with the defaults and limits of each."""

from __future__ import annotations

from dataclasses import dataclass, fields


class WriteOptions:
    format = ""

    def arguments(self) -> dict:
        """Keyword arguments of the format's writer."""
        return {f.name: getattr(self, f.name) for f in fields(self)}


def _limited(of: WriteOptions, name: str, low: float, high: float) -> None:
    object.__setattr__(of, name, min(high, max(low, getattr(of, name))))


@dataclass(frozen=True)
class JpegOptions(WriteOptions):
    quality: float = 0.75
    halve: bool = True
    format = "JPEG"

    def __post_init__(self) -> None:
        _limited(self, "quality", 0.0, 1.0)


@dataclass(frozen=True)
class PngOptions(WriteOptions):
    level: int = 6
    format = "PNG"

    def __post_init__(self) -> None:
        _limited(self, "level", 0, 9)


@dataclass(frozen=True)
class GifOptions(WriteOptions):
    transparent: bool = True
    slot: int = 0
    background: int = 0
    threshold: int = 128
    loop_count: int | None = None
    exact: bool = False
    format = "GIF"


@dataclass(frozen=True)
class TiffOptions(WriteOptions):
    compression: str = "deflate"
    format = "TIFF"

    def __post_init__(self) -> None:
        if self.compression.lower() not in ("none", "lzw", "deflate", "packbits"):
            raise ValueError(f"no compression {self.compression}")


@dataclass(frozen=True)
class TgaOptions(WriteOptions):
    rle: bool = True
    format = "TGA"


@dataclass(frozen=True)
class PnmOptions(WriteOptions):
    variant: str = "ppm"
    ascii: bool = False
    format = "PNM"

    def __post_init__(self) -> None:
        if self.variant not in ("pbm", "pgm", "ppm"):
            raise ValueError(f"no variant {self.variant}")


@dataclass(frozen=True)
class WebpOptions(WriteOptions):
    loop_count: int = 0
    near_lossless: int = 100
    format = "WEBP"

    def __post_init__(self) -> None:
        _limited(self, "near_lossless", 0, 100)
