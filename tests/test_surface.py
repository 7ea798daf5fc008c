import numpy as np
import pytest

from rasterlake.operators import stencils
from rasterlake.operators.canvas import Canvas
from rasterlake.operators.pixels import to_frames
from rasterlake.sources import options, registry, webp
from rasterlake.sources.model import Frame, Picture


def grid(px, w, h):
    return np.array(to_frames(px, w, h).first().argb, np.int32).view(np.uint32).reshape(h, w)


def test_calls_are_laid_in_order(spark):
    c = Canvas(spark, 12, 10, 0xFFFFFFFF).color(0xFFFF0000).fill_rect(2, 2, 5, 4).translate(1, 1).color(0xFF0000FF).draw_line(0, 0, 20, 0).background(0xFF00FF00).clear_rect(3, 3, 2, 2)
    want = np.full((10, 12), 0xFFFFFFFF, np.uint32)
    want[2:6, 2:7] = 0xFFFF0000
    want[1, 1:] = 0xFF0000FF
    want[4:6, 4:6] = 0xFF00FF00
    assert np.array_equal(grid(c.pixels(), 12, 10), want)
    with pytest.raises(NotImplementedError):
        c.draw_text("no")


def test_closed_shapes_meet(spark):
    c = Canvas(spark, 24, 24).color(0xFFFFFFFF).draw_round_rect(2, 2, 18, 14, 8, 6)
    g = grid(c.pixels(), 24, 24) != 0
    assert g[2, 12] and g[16, 12] and g[9, 2] and g[9, 20] and not g[9, 12] and not g[2, 2]
    oval = grid(Canvas(spark, 24, 24).color(0xFFFFFFFF).draw_oval(2, 2, 16, 12).pixels(), 24, 24) != 0
    full = grid(Canvas(spark, 24, 24).color(0xFFFFFFFF).fill_oval(2, 2, 16, 12).pixels(), 24, 24) != 0
    assert oval[8, 2] and oval[8, 18] and oval[2, 10] and oval[14, 10] and not oval[8, 10] and full[8, 2:19].all()
    box = oval[2:15, 2:19]
    assert np.array_equal(box, box[::-1]) and np.array_equal(box, box[:, ::-1]) and full.sum() > oval.sum()
    line = grid(Canvas(spark, 24, 24).color(0xFFFFFFFF).draw_polyline([(1, 1), (20, 4), (9, 22)], True).pixels(), 24, 24) != 0
    solid = grid(Canvas(spark, 24, 24).color(0xFFFFFFFF).fill_polygon([(1, 1), (20, 4), (9, 22)]).pixels(), 24, 24) != 0
    assert solid[8, 9] and not line[8, 9]


def test_options_are_limited_and_used():
    assert options.JpegOptions(7).quality == 1.0 and options.PngOptions(-3).level == 0 and options.WebpOptions(near_lossless=400).near_lossless == 100
    with pytest.raises(ValueError):
        options.TiffOptions("zip")
    p = np.arange(64, dtype=np.uint32).reshape(8, 8) | np.uint32(0xFF000000)
    for o in (options.PngOptions(9), options.TgaOptions(False), options.TiffOptions("lzw"), options.PnmOptions("ppm", True), options.WebpOptions()):
        assert np.array_equal(registry.decode(registry.encode(Picture([Frame(p)], False), o)).first, p)


def test_near_lossless_gets_smaller_and_stays_near():
    y, x = np.mgrid[0:128, 0:128]
    v = np.where((x + y) % 16 == 0, 200, 40 + (x + y) // 8).astype(np.uint32)
    p = np.uint32(0xFF000000) | v << 16 | v << 8 | v
    for level, most in ((100, 0), (60, 3), (0, 47)):
        data = webp.write_webp(Picture([Frame(p)]), near_lossless=level)
        assert abs((webp.read_webp(data).first & 255).astype(int) - (p & 255).astype(int)).max() <= most
    noise = np.uint32(0xFF000000) | np.random.default_rng(2).integers(0, 1 << 24, (70, 70), dtype=np.uint32)
    sizes = [len(webp.write_webp(Picture([Frame(noise)]), near_lossless=level)) for level in (100, 60, 0)]
    assert sizes[0] > sizes[1] > sizes[2]


def test_near_lossless_forms_agree(spark):
    r = np.random.default_rng(4)
    p = r.integers(0, 1 << 32, (9, 11), dtype=np.uint32)
    rows = [(0, x, y, *(int(p[y, x]) >> s & 255 for s in (24, 16, 8, 0))) for y in range(9) for x in range(11)]
    px = spark.createDataFrame(rows, "picture_id bigint, x int, y int, a int, r int, g int, b int")
    for level in (90, 50, 10):
        assert np.array_equal(grid(stencils.near_lossless(px, level, 11, 9, least=0), 11, 9), webp.snapped(p, level, least=0))


def test_frames_are_normalized(spark):
    a, b = [0xFF000000 - (1 << 32)] * 16, [0xFFFF0000 - (1 << 32)] * 64
    frames = spark.createDataFrame([(1, 0, 100, 4, 4, a), (1, 1, 100, 8, 8, b)], "picture_id bigint, frame_idx int, delay_ms int, width int, height int, argb array<int>")
    got = {r.frame_idx: r for r in stencils.normalize_frames(frames).collect()}
    assert [(got[k].width, got[k].height, got[k].delay_ms) for k in (0, 1)] == [(4, 4, 100)] * 2
    assert got[0].argb == a and set(got[1].argb) == {b[0]}
    wide = {r.frame_idx: r for r in stencils.normalize_frames(frames, "contain", False, 8, 8, 0xFF00FF00).collect()}
    assert wide[0].argb.count(a[0]) == 16 and wide[0].argb.count(0xFF00FF00 - (1 << 32)) == 48


def test_base64_files(spark):
    p = np.full((2, 3), 0xFF010203, np.uint32)
    rows = spark.createDataFrame([("a", bytearray(registry.encode(Picture([Frame(p)]), "QOI")))], "path string, content binary")
    back = registry.decode_base64(registry.to_base64(rows)).first()
    assert (back.width, back.height, back.argb[0] & 0xFFFFFFFF) == (3, 2, 0xFF010203)
