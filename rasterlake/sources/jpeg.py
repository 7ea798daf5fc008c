"""Baseline JPEG: sequential, 8 bits, Huffman-coded.

The writer fits its Huffman codes to each picture, so it carries no code tables;
chroma is halved both ways unless asked otherwise.  The reader takes baseline and
extended sequential files; others are ``UnsupportedFormat`` (the JVM's reader
takes more).
"""

from __future__ import annotations

import struct

import numpy as np

from .model import DecodeError, Frame, Picture, UnsupportedFormat, channels, packed
from .webp import code_lengths

#: Quantiser steps at quality 50, row by row, for light and for colour.
LIGHT = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)


def _steps(steps: tuple[int, ...], quality: float) -> np.ndarray:
    base = np.array(steps, np.int64)
    q = min(100, max(1, round(quality * 100)))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((base * scale + 50) // 100, 1, 255).reshape(8, 8)


def _zigzag() -> np.ndarray:
    """Places of the 64 coefficients along the diagonals, turning at each end."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
DCT = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)

# -- writing ---------------------------------------------------------------------------


def _coefficients(plane: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(rows of blocks, blocks, 64) quantised, in zigzag order."""
    h, w = plane.shape
    b = plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2) - 128.0
    c = DCT @ b @ DCT.T / steps
    return np.where(c < 0, -np.floor(0.5 - c), np.floor(c + 0.5)).astype(np.int64).reshape(*b.shape[:2], 64)[..., ZIGZAG]


def _symbols(block: list[int], last: int) -> list[tuple[int, int, int, int]]:
    """(table kind, symbol, extra bits, their number) of one block."""

    def amount(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    n, bits = amount(block[0] - last)
    out, run = [(0, n, bits, n)], 0
    end = max((i for i in range(1, 64) if block[i]), default=0)
    for v in block[1 : end + 1]:
        if v == 0:
            run += 1
            continue
        while run > 15:
            out.append((1, 0xF0, 0, 0))
            run -= 16
        n, bits = amount(v)
        out.append((1, run << 4 | n, bits, n))
        run = 0
    return out if end == 63 else [*out, (1, 0, 0, 0)]


def _fitted(counts: np.ndarray) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A code for these counts: its stored form and (code, length) by symbol; no code is all ones."""
    lengths = code_lengths(np.append(counts, 1), 16)
    lengths[256] = 17  # the extra symbol takes the last and longest place, and is not stored
    if max(n for n in lengths[:256]) == 0:
        lengths[0] = 1
    longest = [s for s in range(256) if lengths[s]]
    longest.sort(key=lambda s: (lengths[s], s))
    out, code, before = {}, 0, 0
    for s in longest:
        code <<= lengths[s] - before
        before = lengths[s]
        out[s] = (code, lengths[s])
        code += 1
    sizes = np.bincount([lengths[s] for s in longest], minlength=17)[1:17]
    return bytes(sizes.tolist()) + bytes(longest), out


def write_jpeg(picture: Picture, quality: float = 0.75, halve: bool = True) -> bytes:
    """Colours as they are over black."""
    p = channels(picture.first).astype(np.float64)
    rgb = p[..., :3] * p[..., 3:] / 255
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    h, w = picture.first.shape
    f = 2 if halve else 1
    unit = 8 * f
    pad = ((0, -h % unit), (0, -w % unit))
    planes = [np.pad(x, pad, mode="edge") for x in planes]
    if halve:
        planes[1:] = [x.reshape(x.shape[0] // 2, 2, x.shape[1] // 2, 2).mean(axis=(1, 3)) for x in planes[1:]]
    steps = [_steps(LIGHT, quality), _steps(COLOUR, quality)]
    grids = [_coefficients(x, steps[k > 0]) for k, x in enumerate(planes)]
    rows, cols = planes[0].shape[0] // unit, planes[0].shape[1] // unit
    last, coded = [0, 0, 0], []
    for y in range(rows):
        for x in range(cols):
            for k, grid in enumerate(grids):
                n = f if k == 0 else 1
                for dy in range(n):
                    for dx in range(n):
                        block = grid[y * n + dy, x * n + dx].tolist()
                        coded += [(2 * (k > 0) + kind, s, e, m) for kind, s, e, m in _symbols(block, last[k])]
                        last[k] = block[0]
    tables = [_fitted(np.bincount([s for t, s, _, _ in coded if t == k], minlength=256)) for k in range(4)]
    value, have, body = 0, 0, bytearray()
    for t, s, extra, n in coded:
        code, size = tables[t][1][s]
        value, have = value << (size + n) | code << n | extra, have + size + n
        while have >= 8:
            byte = value >> (have - 8) & 255
            body.append(byte)
            if byte == 255:
                body.append(0)
            have -= 8
        value &= (1 << have) - 1
    if have:
        byte = (value << (8 - have) | (1 << (8 - have)) - 1) & 255
        body += bytes([byte, 0]) if byte == 255 else bytes([byte])

    def segment(mark: int, content: bytes) -> bytes:
        return struct.pack(">BBH", 255, mark, len(content) + 2) + content

    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for k, s in enumerate(steps):
        out += segment(0xDB, bytes([k]) + bytes(s.ravel()[ZIGZAG].tolist()))
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, f << 4 | f, 0, 2, 17, 1, 3, 17, 1]))
    for k, (stored, _) in enumerate(tables):
        out += segment(0xC4, bytes([(k & 1) << 4 | k >> 1]) + stored)
    return out + segment(0xDA, bytes([3, 1, 0, 2, 17, 3, 17, 0, 63, 0])) + bytes(body) + b"\xff\xd9"


# -- reading -----------------------------------------------------------------------------


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.have = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.have < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            if self.at > len(self.data) + 64:
                raise DecodeError("pixels cut short")
            self.at += 1
            self.value, self.have = (self.value << 8 | byte) & 0xFFFFFFFFFF, self.have + 8

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        self.fill(n)
        self.have -= n
        return self.value >> self.have & ((1 << n) - 1)

    def amount(self, n: int) -> int:
        v = self.read(n)
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table: list[tuple[int, int]]) -> int:
        self.fill(16)
        s, n = table[self.value >> (self.have - 16) & 0xFFFF]
        if n == 0:
            raise DecodeError("bad code")
        self.have -= n
        return s


def _table(content: bytes) -> tuple[list[tuple[int, int]], int]:
    """Look-up by the next 16 bits, and the bytes used."""
    sizes, out, code, at = content[:16], [(0, 0)] * 65536, 0, 16
    for n, count in enumerate(sizes, 1):
        for _ in range(count):
            low = code << (16 - n)
            out[low : low + (1 << (16 - n))] = [(content[at], n)] * (1 << (16 - n))
            code, at = code + 1, at + 1
        code <<= 1
    return out, at


def read_jpeg(data: bytes) -> Picture:
    if data[:2] != b"\xff\xd8":
        raise DecodeError("not a JPEG file")
    at, steps, tables, frame, restart = 2, {}, {}, None, 0
    while True:
        while at + 4 <= len(data) and data[at] == 255 and data[at + 1] == 255:
            at += 1
        if at + 4 > len(data) or data[at] != 255:
            raise DecodeError("segments cut short")
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                steps[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                table, used = _table(body[1:])
                tables[body[0]] = table
                body = body[1 + used :]
        elif mark in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or h == 0 or w == 0:
                raise UnsupportedFormat("this kind of JPEG")
            frame = (h, w, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)])
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise UnsupportedFormat("only sequential JPEG files are read here")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            break
    if frame is None:
        raise DecodeError("no frame before the pixels")
    h, w, parts = frame
    codes = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, 16 | body[2 + 2 * k] & 15) for k in range(body[0])}
    if len(codes) != len(parts):
        raise UnsupportedFormat("pixels in several scans")
    fx, fy = max(p[1] for p in parts), max(p[2] for p in parts)
    cols, rows = -(-w // (8 * fx)), -(-h // (8 * fy))
    grids = [np.zeros((rows * p[2], cols * p[1], 64), np.int64) for p in parts]
    pieces, start = [], at
    while True:  # scans are cut at restart marks; a stuffed zero after 255 goes
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            pieces.append(data[start:])
            break
        if data[k + 1] == 0 or data[k + 1] == 255:
            at = k + 1 + (data[k + 1] == 0)
            continue
        pieces.append(data[start:k])
        at = start = k + 2
        if not 0xD0 <= data[k + 1] <= 0xD7:
            break
    bits, last = None, []
    for unit in range(rows * cols):
        if bits is None or (restart and unit % restart == 0):
            n = unit // restart if restart else 0
            if n >= len(pieces):
                raise DecodeError("pixels cut short")
            bits, last = _Bits(pieces[n].replace(b"\xff\0", b"\xff")), [0] * len(parts)
        y, x = divmod(unit, cols)
        for k, (name, sx, sy, _) in enumerate(parts):
            dc, ac = (tables[c] for c in codes[name])
            for by in range(sy):
                for bx in range(sx):
                    block = grids[k][y * sy + by, x * sx + bx]
                    last[k] += bits.amount(bits.symbol(dc))
                    block[0], i = last[k], 1
                    while i < 64:
                        s = bits.symbol(ac)
                        if s & 15 == 0:
                            if s != 0xF0:
                                break
                            i += 16
                            continue
                        i += s >> 4
                        if i > 63:
                            raise DecodeError("too many coefficients")
                        block[i] = bits.amount(s & 15)
                        i += 1
    planes = []
    for grid, (_, sx, sy, q) in zip(grids, parts):
        c = np.zeros(grid.shape, np.float64)
        c[..., ZIGZAG] = grid * steps[q]
        p = DCT.T @ c.reshape(*grid.shape[:2], 8, 8) @ DCT + 128
        p = p.swapaxes(1, 2).reshape(grid.shape[0] * 8, grid.shape[1] * 8)
        planes.append(np.clip(np.floor(p + 0.5), 0, 255).repeat(fy // sy, axis=0).repeat(fx // sx, axis=1)[:h, :w])
    if len(planes) == 1:
        rgb = np.stack(planes * 3, axis=2)
    else:
        y, u, v = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u], axis=2)
    return Picture([Frame(packed(np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)))], False)
