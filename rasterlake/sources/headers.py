"""What a picture file says about itself at its beginning: format, size and number of frames, without decoding.

A reader gets an open file that can be moved in; it reads a few dozen bytes, and jumps
from chunk to chunk where frames are counted.  ``Counted`` counts the bytes read.
"""

from __future__ import annotations

import re
import struct
from typing import BinaryIO, NamedTuple

from .model import DecodeError, RasterError
from .registry import detect


class Header(NamedTuple):
    format: str
    width: int
    height: int
    frames: int


class Counted:
    """A file of which only what is asked for is read."""

    def __init__(self, f: BinaryIO, size: int):
        self.f, self.size, self.taken = f, size, 0

    def at(self, place: int, n: int) -> bytes:
        if place >= self.size:
            return b""
        self.f.seek(place)
        data = self.f.read(min(n, self.size - place))
        self.taken += len(data)
        return data

    def numbers(self, place: int, layout: str) -> tuple[int, ...]:
        data = self.at(place, struct.calcsize(layout))
        if len(data) < struct.calcsize(layout):
            raise DecodeError("the file ends inside its header")
        return struct.unpack(layout, data)


def _png(f: Counted) -> tuple[int, int, int]:
    return (*f.numbers(16, ">II"), 1)


def _bmp(f: Counted) -> tuple[int, int, int]:
    if f.numbers(14, "<I")[0] == 12:
        return (*f.numbers(18, "<HH"), 1)
    w, h = f.numbers(18, "<ii")
    return w, abs(h), 1


def _qoi(f: Counted) -> tuple[int, int, int]:
    return (*f.numbers(4, ">II"), 1)


def _tga(f: Counted) -> tuple[int, int, int]:
    return (*f.numbers(12, "<HH"), 1)


def _ico(f: Counted) -> tuple[int, int, int]:
    n = f.numbers(4, "<H")[0]
    sizes = [f.numbers(6 + 16 * i, "BB") for i in range(n)]
    w, h = max(((a or 256, b or 256) for a, b in sizes), key=lambda s: s[0] * s[1], default=(0, 0))
    return w, h, n


def _pnm(f: Counted) -> tuple[int, int, int]:
    text = re.sub(rb"#[^\n]*\n", b" ", f.at(2, 1024))
    found = re.match(rb"\s*(\d+)\s+(\d+)", text)
    if not found:
        raise DecodeError("no size in the first kilobyte")
    return int(found[1]), int(found[2]), 1


def _gif(f: Counted) -> tuple[int, int, int]:
    w, h, flags = f.numbers(6, "<HHB")
    place, frames = 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), 0

    def blocks(place: int) -> int:
        while n := f.numbers(place, "B")[0]:
            place += n + 1
        return place + 1

    while kind := f.at(place, 1):
        if kind == b"\x21":
            place = blocks(place + 2)
        elif kind == b"\x2c":
            local = f.numbers(place + 9, "B")[0]
            place = blocks(place + 10 + (3 << (local & 7) + 1 if local & 128 else 0) + 1)
            frames += 1
        else:
            break
    return w, h, frames


def _tiff(f: Counted) -> tuple[int, int, int]:
    order = "<" if f.at(0, 2) == b"II" else ">"
    place, pages, size = f.numbers(4, order + "I")[0], 0, {}
    seen = set()
    while place and place not in seen:
        seen.add(place)
        n = f.numbers(place, order + "H")[0]
        for i in range(n if not pages else 0):
            tag, kind = f.numbers(place + 2 + 12 * i, order + "HH")
            if tag in (256, 257):
                size[tag] = f.numbers(place + 10 + 12 * i, order + ("H" if kind == 3 else "I"))[0]
        place, pages = f.numbers(place + 2 + 12 * n, order + "I")[0], pages + 1
    return size.get(256, 0), size.get(257, 0), pages


def _webp(f: Counted) -> tuple[int, int, int]:
    place, size, frames, stills = 12, None, 0, 0
    while len(name := f.at(place, 4)) == 4:
        n = f.numbers(place + 4, "<I")[0]
        if name == b"VP8X":
            a, b = f.numbers(place + 12, "<HB"), f.numbers(place + 15, "<HB")
            size = (a[0] | a[1] << 16) + 1, (b[0] | b[1] << 16) + 1
        elif name == b"ANMF":
            frames += 1
        elif name == b"VP8L":
            v = f.numbers(place + 9, "<I")[0]
            size, stills = size or ((v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1), 1
        elif name == b"VP8 ":
            w, h = f.numbers(place + 14, "<HH")
            size, stills = size or (w & 0x3FFF, h & 0x3FFF), 1
        place += 8 + n + n % 2
    if size is None:
        raise DecodeError("no chunk with a size")
    return (*size, frames or stills)


def _jpeg(f: Counted) -> tuple[int, int, int]:
    place = 2
    while True:
        mark, kind, n = f.numbers(place, ">BBH")
        if mark != 255:
            raise DecodeError("no marker where one should be")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = f.numbers(place + 5, ">HH")
            return w, h, 1
        place += 1 if kind == 255 else 2 + n


_READERS = {"PNG": _png, "BMP": _bmp, "QOI": _qoi, "TGA": _tga, "ICO": _ico, "PNM": _pnm, "GIF": _gif, "TIFF": _tiff, "WEBP": _webp, "JPEG": _jpeg}


def read_header(f: Counted) -> Header:
    first = f.at(0, 32)
    try:
        format = detect(first)
    except RasterError:  # one format is known by its end
        format = detect(first + f.at(max(32, f.size - 26), 26))
    return Header(format, *_READERS[format](f))
