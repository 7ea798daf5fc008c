"""Damaged files are decode errors, never anything else; palettes and frames against plain versions."""

import numpy as np
import pytest

from rasterlake.functions.quantise import median_cut
from rasterlake.operators import pixels as P
from rasterlake.sources import registry
from rasterlake.sources.model import Frame, Picture, RasterError


def samples(format):
    r = np.random.default_rng(4)
    y, x = np.mgrid[0:9, 0:13]
    for p in (np.uint32(0xFF000000) | (x * 16 << 8) | y * 20, r.integers(0, 1 << 32, (9, 13), dtype=np.uint32) | np.uint32(0xFF000000)):
        yield registry.encode(Picture([Frame(p.astype(np.uint32))], False), format)


@pytest.mark.parametrize("format", registry.formats())
def test_damage_is_a_decode_error(format):
    r = np.random.default_rng(9)
    tried = failed = 0
    for data in samples(format):
        for k in range(60):
            bad = bytearray(data[: int(r.integers(4, len(data)))] if k % 2 else data)
            for at in r.integers(12, max(13, len(bad)), 3 if k % 3 else 0).tolist():
                if at < len(bad):
                    bad[at] = int(r.integers(0, 256))
            tried += 1
            try:
                registry.decode(bytes(bad), format)
            except RasterError:
                failed += 1
    assert tried == 120 and failed > 10


def test_permissive_reading_goes_on_after_a_bad_file(spark):
    good = next(samples("TIFF"))
    files = spark.createDataFrame([("a", good), ("b", good[:20]), ("c", good)], "path string, content binary")
    got = {r.path: r.error for r in registry.decode_files(files, permissive=True).collect()}
    assert got["a"] is None and got["c"] is None and got["b"]


def plain_cut(rows, capacity):
    """(r, g, b, n) rows -> mean colours, one step at a time."""
    buckets = [list(rows)]
    wide = lambda b: [max(x[c] for x in b) - min(x[c] for x in b) for c in range(3)]
    while len(buckets) < capacity and max(max(wide(b)) for b in buckets):
        b = max(buckets, key=lambda b: max(wide(b)))
        buckets.remove(b)
        c = wide(b).index(max(wide(b)))
        b = sorted(b, key=lambda x: x[c])
        half, run, at = sum(x[3] for x in b) // 2, 0, 0
        for at, x in enumerate(b, 1):  # noqa: B007
            run += x[3]
            if run >= half:
                break
        at = max(1, min(at, len(b) - 1))
        buckets += [b[:at], b[at:]]
    return [[sum(x[c] * x[3] for x in b) // sum(x[3] for x in b) for c in range(3)] for b in buckets]


@pytest.mark.parametrize("capacity", [1, 2, 7, 40])
def test_median_cut_equals_a_plain_version(capacity):
    r = np.random.default_rng(capacity)
    colors = np.unique(r.integers(0, 40, (120, 3)), axis=0)
    weight = r.integers(1, 30, len(colors))
    assert median_cut(colors, weight, capacity).tolist() == plain_cut([(*c, n) for c, n in zip(colors.tolist(), weight.tolist())], capacity)


def test_frames_hold_repeated_and_outside_pixels(spark):
    rows = [(1, 0, 0, 255, 1, 2, 3), (1, 0, 0, 255, 9, 2, 3), (1, 1, 1, 255, 7, 7, 7), (1, 2, 0, 255, 1, 1, 1), (1, 0, -1, 255, 1, 1, 1), (2, 5, 5, 255, 1, 1, 1)]
    px = spark.createDataFrame(rows, "picture_id bigint, x int, y int, a int, r int, g int, b int")
    got = {r.picture_id: [v & 0xFFFFFFFF for v in r.argb] for r in P.to_frames(px, 2, 2).collect()}
    assert got == {1: [0xFF090203, 0, 0, 0xFF070707], 2: [0, 0, 0, 0]}


def test_frames_of_a_large_picture_are_laid_out_in_one_pass(spark):
    side = 1000
    px = spark.range(side * side).selectExpr("cast(1 as bigint) picture_id", f"cast(id % {side} as int) x", f"cast(id div {side} as int) y", "255 a", "cast(id % 251 as int) r", "0 g", "0 b")
    row = P.to_frames(px, side, side).selectExpr("width", "size(argb) n", "argb[999999] last").first()
    assert (row.width, row.n, row["last"] & 0xFFFFFFFF) == (side, side * side, 0xFF000000 | (999999 % 251 << 16))
