"""Codecs of formats without entropy coding of note: PNM, BMP, TGA, QOI, ICO, PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .model import DecodeError, EncodeError, Frame, Picture, channels, packed


def _still(argb: np.ndarray, has_alpha: bool) -> Picture:
    return Picture([Frame(argb.astype(np.uint32))], has_alpha)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise DecodeError(message)


# -- portable any-map ---------------------------------------------------------------


def _printed_luma(argb: np.ndarray) -> np.ndarray:
    p = channels(argb).astype(np.int64)
    return (p[..., 0] * 299 + p[..., 1] * 587 + p[..., 2] * 114 + 500) // 1000


def read_pnm(data: bytes) -> Picture:
    """P1 to P6, comments, samples up to 65535; plain bits stand apart by white space."""
    _need(len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456", "not a portable any-map")
    kind, at = data[1] - 48, 2

    def number() -> int:
        nonlocal at
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        start = at
        while at < len(data) and not data[at : at + 1].isspace() and data[at] != 35:
            at += 1
        _need(at > start and data[start:at].isdigit(), "header cut short")
        return int(data[start:at])

    w, h = number(), number()
    most = 1 if kind in (1, 4) else number()
    _need(w > 0 and h > 0 and 1 <= most <= 65535, "bad size or maximum")
    at += at < len(data)
    bands = 3 if kind in (3, 6) else 1
    if kind <= 3:
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = np.array(body.split()[: w * h * bands], dtype=np.int64)
    elif kind == 4:
        row = (w + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at)
        _need(len(raw) >= row * h, "pixels cut short")
        values = np.unpackbits(raw[: row * h].reshape(h, row), axis=1)[:, :w].ravel().astype(np.int64)
    else:
        size = 1 if most < 256 else 2
        _need(len(data) - at >= w * h * bands * size, "pixels cut short")
        values = np.frombuffer(data, ">u2" if size == 2 else np.uint8, w * h * bands, at).astype(np.int64)
    _need(len(values) == w * h * bands, "pixels cut short")
    values = np.where(values == 0, 255, 0) if kind in (1, 4) else np.minimum(255, values * 255 // most)
    return _still(packed(np.broadcast_to(values.reshape(h, w, bands), (h, w, 3))), False)


def write_pnm(picture: Picture, variant: str = "ppm", ascii: bool = False) -> bytes:
    argb = picture.first
    h, w = argb.shape
    bands = {"pbm": 0, "pgm": 1, "ppm": 2}[variant]
    head = f"P{bands + 1 + (0 if ascii else 3)}\n{w} {h}\n" + ("" if bands == 0 else "255\n")
    y = _printed_luma(argb)
    values = (y < 128).astype(np.uint8) if bands == 0 else y.astype(np.uint8) if bands == 1 else channels(argb)[..., :3]
    if ascii:
        return (head + "".join(" ".join(map(str, row.ravel().tolist())) + "\n" for row in values)).encode()
    return head.encode() + (np.packbits(values, axis=1) if bands == 0 else values).tobytes()


# -- bitmap ------------------------------------------------------------------------------


def read_bmp(data: bytes) -> Picture:
    """Uncompressed 1, 4, 8, 24 and 32 bits, bottom-up or top-down."""
    _need(len(data) >= 54 and data[:2] == b"BM", "not a bitmap")
    start, size, w, h, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    _need(packing in (0, 3) and depth in (1, 4, 8, 24, 32) and w > 0 and h != 0, "bitmap kind not supported")
    rows, stride = abs(h), (w * depth + 31) // 32 * 4
    _need(len(data) >= start + stride * rows, "pixels cut short")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    raw = raw if h < 0 else raw[::-1]
    if depth >= 24:
        p = raw[:, : w * depth // 8].reshape(rows, w, depth // 8)
        return _still(packed(p[..., 2::-1]), False)
    colors = np.frombuffer(data, np.uint8, ((start - 14 - size) // 4) * 4, 14 + size).reshape(-1, 4)
    per = 8 // depth
    index = np.stack([raw >> (depth * (per - 1 - k)) & ((1 << depth) - 1) for k in range(per)], axis=2).reshape(rows, -1)[:, :w]
    return _still(packed(colors[index][..., 2::-1]), False)


def write_bmp(picture: Picture) -> bytes:
    """24 bits, bottom-up; colours as they are over black."""
    p = channels(picture.first).astype(np.int64)
    rgb = (p[..., :3] * p[..., 3:] + 127) // 255
    h, w = picture.first.shape
    stride = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


# -- targa ---------------------------------------------------------------------------------

TGA_FOOTER = bytes(8) + b"TRUEVISION-XFILE.\0"


def read_tga(data: bytes) -> Picture:
    """True colour, raw or run-length, 24 or 32 bits, either direction of rows."""
    _need(len(data) >= 18, "header cut short")
    skip, mapped, kind = data[0], data[1], data[2]
    w, h, depth, descriptor = struct.unpack_from("<HHBB", data, 12)
    _need(mapped == 0 and kind in (2, 10) and depth in (24, 32) and w > 0 and h > 0, "this kind of file is not supported")
    size, at, total = depth // 8, 18 + skip, w * h
    if kind == 2:
        _need(len(data) >= at + total * size, "pixels cut short")
        p = np.frombuffer(data, np.uint8, total * size, at).reshape(total, size)
    else:
        parts, n = [], 0
        while n < total:
            _need(at < len(data), "packets cut short")
            count, run = (data[at] & 127) + 1, data[at] >= 128
            own = data[at + 1 : at + 1 + (size if run else size * count)]
            _need(len(own) == (size if run else size * count), "packets cut short")
            _need(n + count <= total, "packets hold too many pixels")
            parts.append(own * count if run else own)
            at, n = at + 1 + len(own), n + count
        p = np.frombuffer(b"".join(parts), np.uint8).reshape(total, size)
    argb = packed(p[:, [2, 1, 0, *([3] if size == 4 else [])]]).reshape(h, w)
    return _still(argb if descriptor & 0x20 else argb[::-1], size == 4)


def write_tga(picture: Picture, rle: bool = True) -> bytes:
    """Top-down with a footer; packets stay within their row."""
    argb, size = picture.first, 4 if picture.has_alpha else 3
    h, w = argb.shape
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 10 if rle else 2, 0, 0, 0, 0, 0, w, h, size * 8, (8 if size == 4 else 0) | 0x20)
    p = np.ascontiguousarray(channels(argb)[..., [2, 1, 0, 3][:size]])
    if not rle:
        return head + p.tobytes() + TGA_FOOTER
    out = bytearray(head)
    for y in range(h):
        row, raw = argb[y], p[y].tobytes()
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])).tolist() + [w]
        loose = None  # first of the single pixels not yet written

        def flush(upto: int) -> None:
            nonlocal loose
            while loose is not None and loose < upto:
                n = min(128, upto - loose)
                out.append(n - 1)
                out.extend(raw[loose * size : (loose + n) * size])
                loose += n
            loose = None

        for a, b in zip(starts[:-1], starts[1:]):
            if b - a == 1:
                loose = a if loose is None else loose
                continue
            flush(a)
            for k in range(a, b, 128):
                n = min(128, b - k)
                out.append(127 + n if n > 1 else 0)
                out.extend(raw[k * size : (k + 1) * size])
        flush(w)
    return bytes(out) + TGA_FOOTER


# -- quite OK picture ---------------------------------------------------------------------------


def _slot(r: int, g: int, b: int, a: int) -> int:
    return (r * 3 + g * 5 + b * 7 + a * 11) & 63


def read_qoi(data: bytes) -> Picture:
    _need(len(data) >= 22 and data[:4] == b"qoif", "not a QOI file")
    w, h, bands = struct.unpack_from(">IIB", data, 4)
    _need(w > 0 and h > 0 and bands in (3, 4), "bad header")
    _need(w * h <= 62 * (len(data) - 22), "more pixels than the longest runs can hold")
    out, table = np.empty(w * h, np.uint32), [(0, 0, 0, 0)] * 64
    r, g, b, a, at, n, end = 0, 0, 0, 255, 14, 0, len(data) - 8
    while n < w * h:
        _need(at < end, f"stream ends at pixel {n} of {w * h}")
        op, count = data[at], 1
        at += 1
        if op == 254:
            r, g, b = data[at : at + 3]
            at += 3
        elif op == 255:
            r, g, b, a = data[at : at + 4]
            at += 4
        elif op < 64:
            r, g, b, a = table[op]
        elif op < 128:
            r, g, b = (r + (op >> 4 & 3) - 2) & 255, (g + (op >> 2 & 3) - 2) & 255, (b + (op & 3) - 2) & 255
        elif op < 192:
            d, low = (op & 63) - 32, data[at]
            r, g, b = (r + d - 8 + (low >> 4)) & 255, (g + d) & 255, (b + d - 8 + (low & 15)) & 255
            at += 1
        else:
            count = (op & 63) + 1
        out[n : n + count] = a << 24 | r << 16 | g << 8 | b
        n += count
        table[_slot(r, g, b, a)] = (r, g, b, a)
    return _still(out.reshape(h, w), bands == 4)


def write_qoi(picture: Picture) -> bytes:
    h, w = picture.first.shape
    out = bytearray(struct.pack(">4sIIBB", b"qoif", w, h, 4 if picture.has_alpha else 3, 0))
    table, last, run = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for p in map(tuple, channels(picture.first).reshape(-1, 4).tolist()):
        if p == last:
            run += 1
            if run == 62:
                out.append(191 + run)
                run = 0
            continue
        if run:
            out.append(191 + run)
            run = 0
        k = _slot(*p)
        if table[k] == p:
            out.append(k)
        elif p[3] != last[3]:
            out += bytes([255, *p])
        else:
            d = [(x - y + 128) % 256 - 128 for x, y in zip(p, last)]
            if all(-2 <= x <= 1 for x in d[:3]):
                out.append(64 | d[0] + 2 << 4 | d[1] + 2 << 2 | d[2] + 2)
            elif -32 <= d[1] <= 31 and -8 <= d[0] - d[1] <= 7 and -8 <= d[2] - d[1] <= 7:
                out += bytes([128 | d[1] + 32, d[0] - d[1] + 8 << 4 | d[2] - d[1] + 8])
            else:
                out += bytes([254, *p[:3]])
        table[k] = last = p
    if run:
        out.append(191 + run)
    return bytes(out) + bytes(7) + b"\1"


# -- portable network graphics --------------------------------------------------------------------

_PNG = b"\x89PNG\r\n\x1a\n"


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows (filter byte first) with their filters undone."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    before = np.zeros(raw.shape[1] - 1, np.uint8)
    for y, row in enumerate(raw):
        kind, line = row[0], row[1:]
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel() if len(line) % step == 0 else line
        elif kind == 2:
            now = line + before
        else:
            now = np.zeros_like(line)
            p, q, l = before.tolist(), now.tolist(), line.tolist()
            for i, v in enumerate(l):
                a, b, c = (q[i - step] if i >= step else 0), p[i], (p[i - step] if i >= step else 0)
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                q[i] = (v + guess) & 255
            now = np.array(q, np.uint8)
        out[y] = before = now
    return out


#: First column, first row, column step and row step of the seven passes of interlacing.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def read_png(data: bytes) -> Picture:
    _need(data[:8] == _PNG, "not a PNG file")
    at, parts, palette, clear, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        _need(len(body) == size, "chunk cut short")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    _need(head is not None and bool(parts), "header or pixels missing")
    w, h, depth, color, _, _, lace = head
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise DecodeError(str(e)) from e
    samples = np.zeros((h, w, bands), np.int64)
    done = 0
    for x0, y0, dx, dy in _PASSES if lace else [(0, 0, 1, 1)]:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        stride = (pw * bands * depth + 7) // 8
        _need(len(raw) >= done + ph * (stride + 1), "pixels cut short")
        rows = _unfiltered(raw[done : done + ph * (stride + 1)].reshape(ph, stride + 1), max(1, bands * depth // 8))
        done += ph * (stride + 1)
        if depth == 16:
            v = rows.view(">u2").astype(np.int64)
        elif depth == 8:
            v = rows.astype(np.int64)
        else:
            v = np.stack([rows >> (depth * (8 // depth - 1 - k)) & ((1 << depth) - 1) for k in range(8 // depth)], axis=2).reshape(ph, -1)[:, : pw * bands].astype(np.int64)
        samples[y0::dy, x0::dx] = v.reshape(ph, pw, bands)
    if color == 3:
        _need(palette is not None and samples.max(initial=0) < len(palette), "palette too short")
        a = np.full(len(palette), 255, np.uint8)
        a[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        return _still(packed(np.concatenate([palette, a[:, None]], axis=1)[samples[..., 0]]), bool(clear))
    key = np.frombuffer(clear, ">u2").astype(np.int64) if clear else None
    full = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
    gray = color in (0, 4)
    rgb = np.broadcast_to(full[..., :1], (h, w, 3)) if gray else full[..., :3]
    if color in (4, 6):
        a = full[..., -1:]
    else:
        a = np.where((samples == key).all(axis=2, keepdims=True), 0, 255) if key is not None else np.full((h, w, 1), 255)
    return _still(packed(np.concatenate([rgb, a], axis=2)), color in (4, 6) or key is not None)


def write_png(picture: Picture, level: int = 6) -> bytes:
    """8 bits with or without alpha; each row takes the filter with the smallest sum of signed residuals."""
    p = channels(picture.first)[..., : 4 if picture.has_alpha else 3]
    h, w, step = p.shape
    rows = p.reshape(h, w * step).astype(np.int16)
    left = np.zeros_like(rows)
    left[:, step:] = rows[:, :-step]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, step:] = rows[:-1, :-step]
    pa, pb, pc = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    nearest = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
    tries = np.stack([rows, rows - left, rows - up, rows - (left + up) // 2, rows - nearest]).astype(np.uint8)
    best = abs(tries.view(np.int8).astype(np.int32)).sum(axis=2).argmin(axis=0)
    body = np.concatenate([best[:, None].astype(np.uint8), tries[best, np.arange(h)]], axis=1).tobytes()

    def chunk(kind: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))

    head = struct.pack(">IIBBBBB", w, h, 8, 6 if step == 4 else 2, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body, min(9, max(0, level)))) + chunk(b"IEND", b"")


# -- icons --------------------------------------------------------------------------------------------


def read_ico(data: bytes) -> Picture:
    """The largest entry, the first of equals; PNG or 32-bit bitmap."""
    _need(len(data) >= 6 and data[:4] == b"\0\0\1\0", "not an icon")
    count = struct.unpack_from("<H", data, 4)[0]
    _need(count > 0 and len(data) >= 6 + 16 * count, "directory empty or cut short")
    entries = [(data[6 + 16 * k] or 256, data[7 + 16 * k] or 256, *struct.unpack_from("<II", data, 14 + 16 * k)) for k in range(count)]
    w, h, size, start = max(entries, key=lambda e: e[0] * e[1])
    _need(size > 0 and start + size <= len(data), "entry out of bounds")
    blob = data[start : start + size]
    if blob[:4] == _PNG[:4]:
        return read_png(blob)
    _need(len(blob) >= 40, "bitmap header cut short")
    skip, depth = struct.unpack_from("<I", blob)[0], struct.unpack_from("<H", blob, 14)[0]
    _need(depth == 32, f"{depth} bits are not supported")
    _need(len(blob) >= skip + 4 * w * h, "pixels cut short")
    p = np.frombuffer(blob, np.uint8, 4 * w * h, skip).reshape(h, w, 4)[::-1]
    return _still(packed(p[..., [2, 1, 0, 3]]), True)


def write_ico(picture: Picture) -> bytes:
    h, w = picture.first.shape
    if max(w, h) > 256:
        raise EncodeError(f"icons are at most 256 pixels wide and high, not {w}x{h}")
    png = write_png(picture)
    return struct.pack("<HHHBBBBHHII", 0, 1, 1, w % 256, h % 256, 0, 0, 1, 32, len(png), 22) + png
