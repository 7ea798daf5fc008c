"""WebP: the container, lossless bitstreams (both ways) and animation.

The lossless format follows its public description (RFC 9649).  Lossy bitstreams,
and the alpha planes that go with them, are not decoded: ``read_webp`` says so.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from .model import EncodeError, DecodeError, Frame, Picture, UnsupportedFormat

# -- container ---------------------------------------------------------------------


def parse_chunks(data: bytes) -> list[tuple[str, bytes]]:
    """(four letters, payload) of each chunk, up to the first that is cut short; odd sizes are padded."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise DecodeError("not a WebP container")
    out, at = [], 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            break
        out.append((data[at : at + 4].decode("latin1"), data[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return out


def build_chunks(chunks: list[tuple[str, bytes]]) -> bytes:
    body = b"".join(k.encode("latin1") + struct.pack("<I", len(p)) + p + b"\0" * (len(p) % 2) for k, p in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


# -- bits -----------------------------------------------------------------------------


class BitReader:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.left, self.at = data, 8 * len(data), 0

    def read(self, n: int) -> int:
        if self.at + n > self.left:
            raise DecodeError("bits run out")
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 5 + (n >> 3)], "little") >> (self.at & 7)
        self.at += n
        return word & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)


class BitWriter:
    def __init__(self):
        self.out, self.held, self.have = bytearray(), 0, 0

    def write(self, value: int, n: int) -> None:
        self.held |= value << self.have
        self.have += n
        while self.have >= 8:
            self.out.append(self.held & 255)
            self.held >>= 8
            self.have -= 8

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.held]) if self.have else b"")


# -- prefix codes ------------------------------------------------------------------------

#: Order in which code lengths of the code-length code are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]


def canonical(lengths: list[int]) -> list[int]:
    """Code of each symbol, bits reversed for writing least significant first."""
    codes, code, before = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code, before = code << (n - before), n
        codes[s] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return codes


class PrefixCode:
    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        if not used:
            self.only = 0
        self.most = max(lengths, default=0)
        if self.only is None:
            if sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
                raise DecodeError("incomplete prefix code")
            self.table = [(0, 0)] * (1 << self.most)
            for s, (n, c) in enumerate(zip(lengths, canonical(lengths))):
                if n:
                    self.table[c :: 1 << n] = [(s, n)] * (1 << (self.most - n))

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.table[bits.peek(self.most)]
        if bits.at + n > bits.left:
            raise DecodeError("bits run out")
        bits.at += n
        return symbol


def read_code(bits: BitReader, size: int) -> PrefixCode:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    code, at, before = PrefixCode(own), 0, 8
    while at < size and left > 0:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        n, value = {16: lambda: (3 + bits.read(2), before), 17: lambda: (3 + bits.read(3), 0), 18: lambda: (11 + bits.read(7), 0)}[s]()
        if at + n > size:
            raise DecodeError("code lengths run over")
        lengths[at : at + n] = [value] * n
        at += n
    return PrefixCode(lengths)


# -- lossless decoding -----------------------------------------------------------------------


#: Fixed values: (columns left, rows up) of the 120 short distance codes, in the order of the format description.
SHORT_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1),
    (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4),
    (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5),
    (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


def _extra(bits: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = SHORT_DISTANCES[code - 1]
    return max(1, dx + dy * width)


def _pixels(bits: BitReader, w: int, h: int, top: bool) -> np.ndarray:
    """An entropy-coded picture of packed colours."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise DecodeError("bad colour cache")
    meta, tile, groups = None, 0, 1
    if top and bits.read(1):
        tile = bits.read(3) + 2
        mw, mh = (w + (1 << tile) - 1) >> tile, (h + (1 << tile) - 1) >> tile
        meta = (_pixels(bits, mw, mh, False) >> 8 & 0xFFFF).reshape(mh, mw)
        groups = int(meta.max()) + 1
    sizes = [256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    out, n, cache, total = [0] * (w * h), 0, [0] * (1 << cache_bits), w * h
    shift = 32 - cache_bits

    def keep(p: int) -> None:
        if cache_bits:
            cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = p

    while n < total:
        green, red, blue, alpha, far = codes[meta[(n // w) >> tile, (n % w) >> tile]] if meta is not None else codes[0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            p = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            out[n] = p
            keep(p)
            n += 1
        elif s < 280:
            length = _extra(bits, s - 256)
            back = _distance(_extra(bits, far.read(bits)), w)
            if back > n or n + length > total:
                raise DecodeError("bad back reference")
            for k in range(n, n + length):
                out[k] = out[k - back]
                keep(out[k])
            n += length
        else:
            out[n] = cache[s - 280]
            keep(out[n])
            n += 1
    return np.array(out, np.uint32)


def _predicted(mode: int, l, t, tl, tr) -> list[int]:
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return [l, t, tr, tl][mode - 1]
    h = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    if mode == 5:
        return h(h(l, tr), t)
    if mode in (6, 7, 8, 9):
        return h(*{6: (l, tl), 7: (l, t), 8: (tl, t), 9: (t, tr)}[mode])
    if mode == 10:
        return h(h(l, tl), h(t, tr))
    if mode == 11:
        return l if sum(abs(x - y) for x, y in zip(t, tl)) < sum(abs(x - y) for x, y in zip(l, tl)) else t
    if mode == 12:
        return [min(255, max(0, a + b - c)) for a, b, c in zip(l, t, tl)]
    m = h(l, t)
    return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(m, tl)]


def _split(p: np.ndarray) -> np.ndarray:
    return np.stack([p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255], axis=-1).astype(np.int64)


def _join(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _undo_prediction(argb: np.ndarray, tile: int, modes: np.ndarray) -> np.ndarray:
    h, w = argb.shape
    rows = _split(argb).tolist()
    kinds = (modes >> 8 & 15).tolist()
    for y in range(h):
        row, up = rows[y], rows[y - 1] if y else None
        for x in range(w):
            if y == 0:
                guess = row[x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                guess = up[0]
            else:
                guess = _predicted(kinds[y >> tile][x >> tile], row[x - 1], up[x], up[x - 1], up[x + 1] if x + 1 < w else row[0])
            row[x] = [(a + b) & 255 for a, b in zip(row[x], guess)]
    return _join(np.array(rows))


def _signed(c: np.ndarray) -> np.ndarray:
    return np.where(c > 127, c - 256, c)


def _undo_color(argb: np.ndarray, tile: int, table: np.ndarray) -> np.ndarray:
    h, w = argb.shape
    t = np.kron(table, np.ones((1 << tile, 1 << tile), np.uint32))[:h, :w].astype(np.int64)
    p = _split(argb)
    g = _signed(p[..., 2])
    p[..., 1] = (p[..., 1] + (_signed(t & 255) * g >> 5)) & 255
    p[..., 3] = (p[..., 3] + (_signed(t >> 8 & 255) * g >> 5) + (_signed(t >> 16 & 255) * _signed(p[..., 1]) >> 5)) & 255
    return _join(p)


def decode_lossless(data: bytes) -> np.ndarray:
    """(height, width) packed colours."""
    bits = BitReader(data)
    if bits.read(8) != 0x2F:
        raise DecodeError("not a lossless bitstream")
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise DecodeError("unknown version")
    undo, width, seen = [], w, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise DecodeError("a transform twice")
        seen.add(kind)
        if kind in (0, 1):
            tile = bits.read(3) + 2
            tw, th = (width + (1 << tile) - 1) >> tile, (h + (1 << tile) - 1) >> tile
            table = _pixels(bits, tw, th, False).reshape(th, tw)
            undo.append(lambda p, tile=tile, table=table, kind=kind: (_undo_color if kind else _undo_prediction)(p, tile, table))
        elif kind == 2:
            undo.append(lambda p: p & np.uint32(0xFF00FF00) | ((p >> 16 & 255) + (p >> 8 & 255) & 255) << 16 | ((p & 255) + (p >> 8 & 255) & 255))
        else:
            n = bits.read(8) + 1
            steps = _split(_pixels(bits, n, 1, False))
            colors = np.concatenate([_join(np.cumsum(steps, axis=0) & 255), np.zeros(256 - n, np.uint32)])
            pack = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1

            def unpack(p: np.ndarray, colors=colors, pack=pack, full=width) -> np.ndarray:
                g = (p >> 8 & 255).astype(np.int64)
                each = 8 // pack
                index = np.stack([g >> (each * k) & ((1 << each) - 1) for k in range(pack)], axis=2).reshape(p.shape[0], -1)[:, :full]
                return colors[index]

            undo.append(unpack)
            width = (width + pack - 1) // pack
    argb = _pixels(bits, width, h, True).reshape(h, width)
    for f in reversed(undo):
        argb = f(argb).astype(np.uint32)
    return argb


# -- lossless encoding -------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = 15) -> list[int]:
    """Huffman lengths, none above the limit: small counts are raised until it holds."""
    used = [i for i, n in enumerate(counts.tolist()) if n]
    lengths = [0] * len(counts)
    if len(used) <= 1:
        for i in used:
            lengths[i] = 1
        return lengths
    least = 1
    while True:
        heap = [(max(int(counts[i]), least), i, (i,)) for i in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            for s, d in depth.items():
                lengths[s] = d
            return lengths
        least *= 2


def _write_code(out: BitWriter, counts: np.ndarray) -> tuple[list[int], list[int]]:
    """Writes the code of these counts; (lengths, codes) for its symbols."""
    used = np.flatnonzero(counts).tolist()
    if len(used) <= 2 and all(u < 256 for u in used):
        used = used or [0]
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        wide = used[0] > 1
        out.write(wide, 1)
        out.write(used[0], 8 if wide else 1)
        lengths = [0] * len(counts)
        if len(used) == 2:
            out.write(used[1], 8)
            for u in used:
                lengths[u] = 1
        return lengths, canonical(lengths)
    lengths = code_lengths(counts)
    if len(used) == 1:
        lengths[0 if used[0] else 1] = 1  # a code of one symbol above 255 needs a second
    tokens, at = [], 0
    while at < len(lengths):
        run = 1
        while at + run < len(lengths) and lengths[at + run] == lengths[at]:
            run += 1
        if lengths[at] == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        else:
            run = 1
            tokens.append((lengths[at], 0, 0))
        at += run
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    if sum(1 for n in own if n) == 1:
        own[next(i for i in range(19) if not own[i])] = 1
    count = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if own[s]))
    out.write(0, 1)
    out.write(count - 4, 4)
    for s in LENGTH_ORDER[:count]:
        out.write(own[s], 3)
    out.write(0, 1)
    codes = canonical(own)
    for s, extra, n in tokens:
        out.write(codes[s], own[s])
        if n:
            out.write(extra, n)
    return lengths, canonical(lengths)


def prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, extra value) of a length or distance code."""
    if value < 5:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), n, v & ((1 << n) - 1)


def _tokens(p: list[int], width: int) -> list[tuple]:
    """Literals and back references: the longest of the last few places with the same three pixels."""
    out, at, seen = [], 0, {}
    while at < len(p):
        best, back = 0, 0
        key = tuple(p[at : at + 3])
        if len(key) == 3:
            for start in reversed(seen.get(key, [])[-16:]):
                n = 3
                while n < 4095 and at + n < len(p) and p[start + n] == p[at + n]:
                    n += 1
                if n > best:
                    best, back = n, at - start
        step = best if best >= 4 else 1
        out.append((best, back + 120) if best >= 4 else (p[at],))
        for k in range(at, min(at + step, len(p) - 2)):
            seen.setdefault(tuple(p[k : k + 3]), []).append(k)
        at += step
    return out


def _write_pixels(out: BitWriter, argb: np.ndarray, top: bool) -> None:
    out.write(0, 1)
    if top:
        out.write(0, 1)
    tokens = _tokens(argb.ravel().tolist(), argb.shape[1])
    counts = [np.zeros(n, np.int64) for n in (280, 256, 256, 256, 40)]
    for t in tokens:
        if len(t) == 1:
            for c, s in zip(counts, (8, 16, 0, 24)):
                c[t[0] >> s & 255] += 1
        else:
            counts[0][256 + prefix(t[0])[0]] += 1
            counts[4][prefix(t[1])[0]] += 1
    codes = [_write_code(out, c) for c in counts]
    single = [sum(1 for n in l if n) <= 1 for l, _ in codes]

    def put(k: int, symbol: int) -> None:
        if not single[k]:
            out.write(codes[k][1][symbol], codes[k][0][symbol])

    for t in tokens:
        if len(t) == 1:
            for k, s in enumerate((8, 16, 0, 24)):
                put(k, t[0] >> s & 255)
        else:
            s, n, v = prefix(t[0])
            put(0, 256 + s)
            out.write(v, n)
            s, n, v = prefix(t[1])
            put(4, s)
            out.write(v, n)


def _as_is(out: BitWriter, argb: np.ndarray) -> np.ndarray:
    return argb


def _less_green(out: BitWriter, argb: np.ndarray) -> np.ndarray:
    out.write(1, 1)
    out.write(2, 2)
    p = _split(argb)
    p[..., 1] = (p[..., 1] - p[..., 2]) & 255
    p[..., 3] = (p[..., 3] - p[..., 2]) & 255
    return _join(p)


def _by_left(out: BitWriter, argb: np.ndarray) -> np.ndarray:
    """One prediction for the whole picture: the pixel to the left, or above in the first column."""
    out.write(1, 1)
    out.write(0, 2)
    out.write(7, 3)
    h, w = argb.shape
    _write_pixels(out, np.full(((h + 511) >> 9, (w + 511) >> 9), 0xFF000100, np.uint32), False)
    p = _split(argb)
    guess = np.zeros_like(p)
    guess[:, 1:] = p[:, :-1]
    guess[1:, 0] = p[:-1, 0]
    guess[0, 0] = [255, 0, 0, 0]
    return _join((p - guess) & 255)


def _by_palette(out: BitWriter, argb: np.ndarray) -> np.ndarray:
    colors, index = np.unique(argb, return_inverse=True)
    index = index.reshape(argb.shape)
    out.write(1, 1)
    out.write(3, 2)
    out.write(len(colors) - 1, 8)
    p = _split(colors)
    p[1:] = (p[1:] - p[:-1]) & 255
    _write_pixels(out, _join(p)[None, :], False)
    pack = 8 if len(colors) <= 2 else 4 if len(colors) <= 4 else 2 if len(colors) <= 16 else 1
    h, w = argb.shape
    wide = np.zeros((h, -(-w // pack) * pack), np.int64)
    wide[:, :w] = index
    each = 8 // pack
    value = (wide.reshape(h, -1, pack) << (each * np.arange(pack))).sum(axis=2)
    return (0xFF000000 | value << 8).astype(np.uint32)


def encode_lossless(argb: np.ndarray) -> bytes:
    """The smallest of: as it is, less green, by the left neighbour, and by palette where colours are few."""
    h, w = argb.shape
    ways = [_as_is, _less_green, _by_left] + ([_by_palette] if len(np.unique(argb)) <= 256 else [])
    tries = []
    for way in ways:
        out = BitWriter()
        out.write(0x2F, 8)
        out.write(w - 1, 14)
        out.write(h - 1, 14)
        out.write(1, 1)
        out.write(0, 3)
        body = way(out, argb)
        out.write(0, 1)
        _write_pixels(out, body, True)
        tries.append(out.done())
    return min(tries, key=len)


# -- files ------------------------------------------------------------------------------------------


def _u24(v: int) -> bytes:
    return v.to_bytes(3, "little")


def over(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Straight-alpha "over" of packed colours, truncating."""
    s, d = _split(src), _split(dst)
    keep = d[..., :1] * (255 - s[..., :1])
    a = s[..., :1] + keep // 255
    mixed = np.concatenate([a, (s[..., 1:] * s[..., :1] + d[..., 1:] * keep // 255) // np.maximum(a, 1)], axis=-1)
    out = np.where(s[..., :1] == 255, s, np.where(s[..., :1] == 0, d, mixed))
    return _join(out)


def _sub_chunks(body: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at + 8 <= len(body):
        size = struct.unpack_from("<I", body, at + 4)[0]
        if at + 8 + size > len(body):
            raise DecodeError("a frame's chunk is cut short")
        out[body[at : at + 4].decode("latin1")] = body[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return out


def read_webp(data: bytes) -> Picture:
    """Stills and animations of lossless frames; animations come as whole canvases."""
    chunks = parse_chunks(data)
    found = dict(chunks)
    if "ANIM" not in found:
        if "VP8L" in found:
            return Picture([Frame(decode_lossless(found["VP8L"]))], True)
        if "VP8 " in found:
            raise UnsupportedFormat("lossy WebP bitstreams are not decoded")
        raise DecodeError("no picture in the container")
    w, h = (1 + int.from_bytes(found["VP8X"][k : k + 3], "little") for k in (4, 7))
    if max(w, h) > 16383:
        raise DecodeError("canvas too large")
    background, loop = struct.unpack_from("<IH", found["ANIM"])
    canvas, frames, gone = np.full((h, w), background, np.uint32), [], None
    for kind, body in chunks:
        if kind != "ANMF":
            continue
        if len(body) < 16:
            raise DecodeError("a frame is cut short")
        x, y, fw, fh, ms = (int.from_bytes(body[k : k + 3], "little") for k in (0, 3, 6, 9, 12))
        x, y, fw, fh, flags = 2 * x, 2 * y, fw + 1, fh + 1, body[15]
        parts = _sub_chunks(body[16:])
        if "VP8L" not in parts:
            raise UnsupportedFormat("lossy WebP bitstreams are not decoded") if "VP8 " in parts else DecodeError("a frame without a picture")
        p = decode_lossless(parts["VP8L"])
        if p.shape != (fh, fw):
            raise DecodeError("a frame has another size than it says")
        if gone:
            canvas[gone] = background
        at = (slice(y, min(h, y + fh)), slice(x, min(w, x + fw)))
        p = p[: at[0].stop - y, : at[1].stop - x]
        canvas[at] = p if flags & 2 else over(p, canvas[at])
        gone = at if flags & 1 else None
        frames.append(Frame(canvas.copy(), ms, 0, 0, "RESTORE_TO_BACKGROUND" if flags & 1 else "DO_NOT_DISPOSE", "SOURCE" if flags & 2 else "OVER"))
    if not frames:
        raise DecodeError("an animation without frames")
    return Picture(frames, True, loop, background, w, h)


def snapped(argb: np.ndarray, level: int, least: int = 64) -> np.ndarray:
    """Near-lossless: busy pixels lose up to 5 low bits, smooth ones and the border none; level 100 keeps all."""
    bits = 5 - max(0, level) // 20
    h, w = argb.shape
    if level >= 100 or bits <= 0 or (w < least and h < least) or h < 3:
        return argb
    p = _split(argb)
    for b in range(bits, 0, -1):
        c = p[1:-1, 1:-1]
        far = np.max([abs(c - q).max(axis=2) for q in (p[1:-1, :-2], p[1:-1, 2:], p[:-2, 1:-1], p[2:, 1:-1])], axis=0)
        biased = c + ((1 << b) - 1 >> 1) + (c >> b & 1)
        less = np.where(biased > 255, 255, biased >> b << b)
        p = p.copy()
        p[1:-1, 1:-1] = np.where((far < 1 << b)[..., None], c, less)
    return _join(p)


def write_webp(picture: Picture, loop_count: int = 0, near_lossless: int = 100) -> bytes:
    """Lossless, or nearly; frames of an animation after the first hold only the box that changed."""
    if near_lossless < 100:
        frames = [Frame(snapped(f.argb, near_lossless), f.delay_ms, f.x, f.y, f.disposal, f.blend) for f in picture.frames]
        picture = Picture(frames, picture.has_alpha, picture.loop_count, picture.background, picture.width, picture.height)
    if len(picture.frames) == 1:
        return build_chunks([("VP8L", encode_lossless(picture.first))])
    h, w = picture.first.shape
    out = [("VP8X", struct.pack("<I", 0x12) + _u24(w - 1) + _u24(h - 1)), ("ANIM", struct.pack("<IH", picture.background & 0xFFFFFFFF, loop_count or picture.loop_count))]
    before = None
    for f in picture.frames:
        if f.argb.shape != (h, w):
            raise EncodeError("frames of an animation share one size")
        box = (0, 0, w, h)
        if before is not None:
            ys, xs = np.nonzero(before != f.argb)
            box = (0, 0, 1, 1)
            if len(ys):
                x, y = int(xs.min()) & ~1, int(ys.min()) & ~1
                box = (x, y, int(xs.max()) - x + 1, int(ys.max()) - y + 1)
        x, y, bw, bh = box
        body = encode_lossless(np.ascontiguousarray(f.argb[y : y + bh, x : x + bw]))
        head = _u24(x // 2) + _u24(y // 2) + _u24(bw - 1) + _u24(bh - 1) + _u24(f.delay_ms) + bytes([2])
        out.append(("ANMF", head + b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)))
        before = f.argb
    return build_chunks(out)


# -- rows of chunks ------------------------------------------------------------------------


def chunk_rows(blobs):
    """(path, content) -> (path, ord, kind, size) for each chunk of each container; other files give none."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                content = bytes(content)
                if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
                    rows += [(path, k, kind, len(body)) for k, (kind, body) in enumerate(parse_chunks(content))]
            yield pd.DataFrame(rows, columns=["path", "ord", "kind", "size"])

    return blobs.select("path", "content").mapInPandas(run, "path string, ord int, kind string, size bigint")
