"""GIF and TIFF: the codecs with LZW, palettes and several frames."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..functions.quantise import median_cut
from .model import DISPOSALS, DecodeError, EncodeError, Frame, Picture, channels, packed


def lzw_decode(data: bytes, bits: int, msb: bool) -> bytes:
    """msb: most significant bit first and one code early, as in TIFF; else as in GIF."""
    clear, stop = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    out, held, have, width, last = [], 0, 0, bits + 1, b""
    for byte in data:
        if msb:
            held = (held << 8 | byte) & 0xFFFFFFFF
        else:
            held |= byte << have
        have += 8
        while have >= width:
            if msb:
                code = held >> (have - width) & ((1 << width) - 1)
            else:
                code = held & ((1 << width) - 1)
                held >>= width
            have -= width
            if code == clear:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                width, last = bits + 1, b""
                continue
            if code == stop:
                return b"".join(out)
            if not table:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
            if code < len(table):
                now = table[code]
            elif code == len(table) and last:
                now = last + last[:1]
            else:
                raise DecodeError("bad LZW code")
            out.append(now)
            if last and len(table) < 4096:
                table.append(last + now[:1])
            last = now
            if len(table) + msb >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def lzw_encode(data: bytes, bits: int, msb: bool) -> bytes:
    clear, stop = 1 << bits, (1 << bits) + 1
    out, held, have, width = bytearray(), 0, 0, bits + 1

    def put(code: int) -> None:
        nonlocal held, have
        if msb:
            held, have = held << width | code, have + width
            while have >= 8:
                out.append(held >> (have - 8) & 255)
                have -= 8
            held &= (1 << have) - 1
        else:
            held, have = held | code << have, have + width
            while have >= 8:
                out.append(held & 255)
                held, have = held >> 8, have - 8

    table = {bytes([i]): i for i in range(clear)}
    put(clear)
    n, word = clear + 2, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = n
        n += 1
        if n + msb > 1 << width:
            if width < 12:
                width += 1
        if n >= 4094:
            put(clear)
            table, n, width = {bytes([i]): i for i in range(clear)}, clear + 2, bits + 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        n += 1
        if n + msb > 1 << width and width < 12:
            width += 1
    put(stop)
    if have:
        out.append(held << (8 - have) & 255 if msb else held & 255)
    return bytes(out)


# -- GIF ------------------------------------------------------------------------------------


def read_gif(data: bytes) -> Picture:
    """All frames as they are stored, with offset, delay (0 means 100 ms) and disposal; nothing is composed."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise DecodeError("not a GIF file")
    w, h, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 128:
        n = 2 << (flags & 7)
        common, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    frames, loop, delay, disposal, clear = [], 0, 100, "NONE", None

    def blocks(k: int) -> tuple[bytes, int]:
        parts = []
        while k < len(data) and data[k]:
            parts.append(data[k + 1 : k + 1 + data[k]])
            k += 1 + data[k]
        return b"".join(parts), k + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, nxt = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                bits, cs, index = struct.unpack_from("<BHB", body)
                delay, clear = (cs * 10 or 100), index if bits & 1 else None
                disposal = DISPOSALS[bits >> 2 & 7] if (bits >> 2 & 7) < 4 else "NONE"
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                loop = struct.unpack_from("<H", body, 12)[0]
            at = nxt
        elif data[at] == 0x2C:
            x, y, fw, fh, bits = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colors = common
            if bits & 128:
                n = 2 << (bits & 7)
                colors, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
            if colors is None:
                raise DecodeError("no palette")
            body, nxt = blocks(at + 1)
            index = np.frombuffer(lzw_decode(body, data[at], False), np.uint8)
            if len(index) < fw * fh:
                raise DecodeError("pixels cut short")
            index = index[: fw * fh].reshape(fh, fw)
            if bits & 64:
                order = np.concatenate([np.arange(s, fh, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                index = index[np.argsort(order, kind="stable")]
            argb = packed(colors)[np.minimum(index, len(colors) - 1)]
            if clear is not None:
                argb = np.where(index == clear, np.uint32(0), argb)
            frames.append(Frame(argb.astype(np.uint32), delay, x, y, disposal))
            at, delay, disposal, clear = nxt, 100, "NONE", None
        else:
            raise DecodeError(f"unknown block {data[at]}")
    if not frames:
        raise DecodeError("no frames")
    if len(frames) == 1:
        frames[0].delay_ms = 0
        return Picture(frames, True)
    return Picture(frames, True, loop, 0, w, h)


def quantized(delays: list[int], minimum: int) -> list[int]:
    """Delays in hundredths; the running total stays on time."""
    out, elapsed, emitted = [], 0, 0
    for d in delays:
        elapsed += d
        out.append(max(minimum, (elapsed + 5) // 10 - emitted))
        emitted += out[-1]
    return out


def shared_palette(flat: list[np.ndarray], slot: int | None) -> np.ndarray:
    """Up to 256 colours of all frames, by first appearance if they fit, else by median cut; a slot may be left free."""
    every = np.concatenate([f.ravel() for f in flat])
    rgb, first, n = np.unique(every[every >> 24 != 0] & 0xFFFFFF, return_index=True, return_counts=True)
    room = 256 - (slot is not None)
    order = np.argsort(first, kind="stable")
    rgb, n = rgb[order], n[order]
    colors = np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], axis=1).astype(np.int64)
    if len(rgb) > room:
        colors = median_cut(colors, n, room)
    if slot is not None:
        at = min(slot, len(colors))
        colors = np.insert(colors, at, 0, axis=0)
    return colors if len(colors) else np.zeros((1, 3), np.int64)


def write_gif(picture: Picture, transparent: bool = True, slot: int = 0, background: int = 0, threshold: int = 128, loop_count: int | None = None, exact: bool = False) -> bytes:
    """Frames flattened onto the background, one palette for all, delays that keep time."""
    flat = []
    for f in picture.frames:
        p = channels(f.argb).astype(np.int64)
        a, bg = p[..., 3:], np.array([background >> 16 & 255, background >> 8 & 255, background & 255])
        argb = packed((p[..., :3] * a + bg * (255 - a)) // 255)
        flat.append(np.where(p[..., 3] < threshold, np.uint32(0), argb) if transparent else argb)
    colors = shared_palette(flat, slot if transparent else None)
    slot = min(slot, len(colors) - 1)
    usable = np.setdiff1d(np.arange(len(colors)), [slot]) if transparent and len(colors) > 1 else np.arange(len(colors))
    bits = max(2, int(len(colors) - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(colors)] = colors
    w, h = max(f.x + f.width for f in picture.frames), max(f.y + f.height for f in picture.frames)
    if max(w, h) > 65535:
        raise EncodeError("too large")
    out = bytearray(struct.pack("<6sHHBBB", b"GIF89a", w, h, 0xF0 | bits - 1, 0, 0) + table.tobytes())
    if len(picture.frames) > 1:
        out += b"\x21\xff\x0bNETSCAPE2.0" + struct.pack("<BBHB", 3, 1, picture.loop_count if loop_count is None else loop_count, 0)
    for f, argb, cs in zip(picture.frames, flat, quantized([f.delay_ms for f in picture.frames], 1 if exact else 2)):
        rgb, inverse = np.unique(argb & 0xFFFFFF, return_inverse=True)
        p = np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], axis=1).astype(np.int64)
        nearest = usable[((p[:, None, :] - colors[None, usable]) ** 2).sum(axis=2).argmin(axis=1)]
        index = nearest[inverse].reshape(argb.shape)
        if transparent:
            index = np.where(argb >> 24 == 0, slot, index)
        code = DISPOSALS.index(f.disposal) if f.disposal in DISPOSALS else 0
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, code << 2 | transparent, cs if len(picture.frames) > 1 else 0, slot if transparent else 0, 0)
        out += struct.pack("<BHHHHBB", 0x2C, f.x, f.y, f.width, f.height, 0, bits)
        body = lzw_encode(index.astype(np.uint8).tobytes(), bits, False)
        for k in range(0, len(body), 255):
            part = body[k : k + 255]
            out += bytes([len(part)]) + part
        out.append(0)
    return bytes(out) + b";"


# -- TIFF --------------------------------------------------------------------------------------


def _unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not (end + 1 < len(data) and data[end] == data[end + 1]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


def read_tiff(data: bytes) -> Picture:
    """Strips of 8-bit gray, palette, RGB and RGBA, plain, LZW, deflate or packed bits; several pages are frames of 100 ms."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise DecodeError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    frames, alpha, at = [], False, struct.unpack_from(order + "I", data, 4)[0]
    kinds = {1: "B", 2: "B", 3: "H", 4: "I"}
    seen = set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in kinds:
                continue
            form = f"{order}{count}{kinds[kind]}"
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            tags[tag] = struct.unpack_from(form, data, place)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        try:
            w, h, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
            packing, color, predictor = tags.get(259, (1,))[0], tags[262][0], tags.get(317, (1,))[0]
            strips = zip(tags[273], tags[279])
        except KeyError as e:
            raise DecodeError(f"tag {e} missing") from e
        if set(tags.get(258, (8,))) != {8}:
            raise DecodeError("only 8 bits a sample are supported")
        unpack = {1: bytes, 5: lambda b: lzw_decode(b, 8, True), 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpackbits}
        if packing not in unpack:
            raise DecodeError(f"packing {packing} is not supported")
        raw = np.frombuffer(b"".join(unpack[packing](data[s : s + c]) for s, c in strips), np.uint8)
        if len(raw) < w * h * bands:
            raise DecodeError("pixels cut short")
        p = raw[: w * h * bands].reshape(h, w, bands)
        if predictor == 2:
            p = np.add.accumulate(p, axis=1, dtype=np.uint8)
        if color == 3:
            m = (np.array(tags[320]).reshape(3, -1) >> 8).T
            p = m[p[..., 0]]
        elif color in (0, 1):
            g = 255 - p[..., :1] if color == 0 else p[..., :1]
            p = np.concatenate([np.broadcast_to(g, (h, w, 3)), *([p[..., 1:2]] if bands > 1 else [])], axis=2)
        alpha |= p.shape[2] >= 4
        frames.append(Frame(packed(p[..., :4]), 100))
    if not frames:
        raise DecodeError("no pages")
    if len(frames) == 1:
        frames[0].delay_ms = 0
    return Picture(frames, alpha)


def write_tiff(picture: Picture, compression: str = "deflate") -> bytes:
    """A page for each frame, one strip each."""
    code, pack = {"none": (1, bytes), "lzw": (5, lambda b: lzw_encode(b, 8, True)), "deflate": (8, zlib.compress), "packbits": (32773, _packbits)}[compression.lower()]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for f in picture.frames:
        p = channels(f.argb)[..., : 4 if picture.has_alpha else 3]
        body, bands = pack(p.tobytes()), p.shape[2]
        start = len(out)
        out += body + b"\0" * (len(body) % 2)
        bits = len(out)
        out += struct.pack(f"<{bands}H", *[8] * bands)
        struct.pack_into("<I", out, link, len(out))
        entries = [(256, 4, 1, f.width), (257, 4, 1, f.height), (258, 3, bands, bits), (259, 3, 1, code), (262, 3, 1, 2), (273, 4, 1, start), (277, 3, 1, bands), (278, 4, 1, f.height), (279, 4, 1, len(body))]
        entries += [(338, 3, 1, 2)] if bands == 4 else []
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)
