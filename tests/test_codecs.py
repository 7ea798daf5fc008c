import numpy as np
import pytest

from rasterlake.sources import jpeg, lzw, plain, registry, webp
from rasterlake.sources.model import DecodeError, EncodeError, Frame, Picture, UnsupportedFormat

SOLID = np.uint32(0xFF000000)


def pictures():
    r = np.random.default_rng(5)
    y, x = np.mgrid[0:37, 0:53]
    yield np.full((1, 1), 0x80112233, np.uint32)
    yield (SOLID | (x * 4 << 16) | (y * 6 << 8) | (x + y & 255)).astype(np.uint32)
    yield r.integers(0, 1 << 32, (19, 23), dtype=np.uint32)
    yield np.where((x // 4 + y // 3) % 2 == 0, 0xFF00FF00, 0xFFFF0000).astype(np.uint32)
    yield np.array([0xFF000000, 0xFF808080, 0, 0x40FFFFFF], np.uint32)[r.integers(0, 4, (30, 200))]


@pytest.mark.parametrize("format,options", [("PNG", {}), ("PNG", {"level": 0}), ("QOI", {}), ("TGA", {}), ("TGA", {"rle": False}), ("ICO", {}), ("WEBP", {}), ("TIFF", {}), *(("TIFF", {"compression": c}) for c in ("none", "lzw", "packbits"))])
def test_round_trip_with_alpha(format, options):
    for p in pictures():
        data = registry.encode(Picture([Frame(p)]), format, **options)
        assert registry.detect(data) == format
        assert np.array_equal(registry.decode(data).first, p)


@pytest.mark.parametrize("format,options", [("BMP", {}), ("PNM", {}), ("PNM", {"ascii": True}), ("PNG", {}), ("TGA", {}), ("QOI", {})])
def test_round_trip_opaque(format, options):
    for p in pictures():
        p = p | SOLID
        assert np.array_equal(registry.decode(registry.encode(Picture([Frame(p)], False), format, **options)).first, p)


def test_gif_keeps_few_colours_time_and_loop():
    p = np.where(np.indices((20, 30)).sum(axis=0) % 3 == 0, 0xFF112233, 0xFFAABBCC).astype(np.uint32)
    back = registry.decode(lzw.write_gif(Picture([Frame(p, 50, 2, 4, "RESTORE_TO_BACKGROUND"), Frame(p, 33)], True, 7)))
    assert np.array_equal(back.first, p) and back.loop_count == 7
    assert [f.delay_ms for f in back.frames] == [50, 30] and (back.frames[0].x, back.frames[0].y, back.frames[0].disposal) == (2, 4, "RESTORE_TO_BACKGROUND")


def test_gif_clears_below_the_threshold():
    p = np.array([[0x7F102030, 0x80102030, 0xFF102030]], np.uint32)
    back = lzw.read_gif(lzw.write_gif(Picture([Frame(p)]))).first
    assert (back[0] >> 24).tolist() == [0, 255, 255]


@pytest.mark.parametrize("delays,minimum,want", [([50] * 4, 2, [5] * 4), ([33] * 60, 2, 198), ([19] * 100, 1, 190), ([19] * 100, 2, 200), ([17, 17, 16], 1, [2, 1, 2]), ([17, 17, 16], 2, [2, 2, 2])])
def test_delays(delays, minimum, want):
    got = lzw.quantized(delays, minimum)
    assert (got if isinstance(want, list) else sum(got)) == want


def test_lossless_streams_of_another_encoder():
    red = webp.decode_lossless(bytes.fromhex("2f014000000710fd8ffe0722a2ff01"))
    assert (red == 0xFFFF0000).all() and red.shape == (2, 2)
    noisy = webp.decode_lossless(bytes.fromhex("2f03c000001f201048de1f3a8df9171014f93fdafc474e0e40204084583467426344ff630c"))
    assert noisy[0].tolist() == [0xFFFF0000, 0xFF00FF00, 0xFF0000FF, 0xFFFFFF00] and noisy[3].tolist() == [0xFF00FF00, 0xFF0000FF, 0xFFFFFF00, 0xFFFF0000]
    slope = webp.decode_lossless(bytes.fromhex("2f0fc00300b93244f43f7611d1ff0091b64d25dcbfe1c1d381889800ac43fd07"))
    y, x = np.mgrid[0:16, 0:16]
    assert (slope == (SOLID | (x * 16 << 16) | (y * 16 << 8))).all()


def test_webp_animation_stores_changed_boxes():
    a = np.full((96, 96), 0xFF008080, np.uint32)
    frames = [Frame(a.copy(), 50) for _ in range(5)]
    for k, f in enumerate(frames):
        f.argb[40:48, 40:48] = 0xFF000000 | 64 * k * 0x010101 & 0xFFFFFF
    data = webp.write_webp(Picture(frames, True, 3))
    back = webp.read_webp(data)
    assert all(np.array_equal(f.argb, g.argb) for f, g in zip(frames, back.frames)) and back.loop_count == 3
    assert len(data) <= 20_000


def test_pnm_comments_and_wide_samples():
    assert plain.read_pnm(b"P3\n# this is a comment\n2 1\n255\n0 0 0 255 255 255\n").first.tolist() == [[0xFF000000, 0xFFFFFFFF]]
    assert plain.read_pnm(b"P5 1 1 65535\n\x80\x00").first[0, 0] & 255 == 127
    assert plain.read_pnm(b"P1 2 1 1 0").first.tolist() == [[0xFF000000, 0xFFFFFFFF]]


@pytest.mark.parametrize("format", ["PNG", "QOI", "TGA", "BMP", "GIF", "TIFF", "ICO", "WEBP", "PNM"])
def test_cut_short_files_are_errors(format):
    p = next(x for i, x in enumerate(pictures()) if i == 1)
    data = registry.encode(Picture([Frame(p)], format not in ("BMP",)), format)
    with pytest.raises(Exception) as e:
        registry.decode(data[: len(data) // 2], format)
    assert not isinstance(e.value, (IndexError, KeyError)) or format in ("QOI", "GIF", "TIFF")


def test_unknown_and_too_large():
    with pytest.raises(UnsupportedFormat):
        registry.detect(b"nothing known")
    with pytest.raises(EncodeError):
        plain.write_ico(Picture([Frame(np.zeros((1, 257), np.uint32))]))
    with pytest.raises(DecodeError):
        plain.read_ico(b"\0\0\1\0\0\0")


def test_a_registered_codec_serves_what_others_do_not_claim():
    registry.register(registry.Codec("FLAT", lambda d: d[:4] == b"FLAT", lambda d: Picture([Frame(np.full((1, d[4]), SOLID))]), None))
    try:
        assert registry.decode(b"FLAT\3").width == 3
    finally:
        registry._CODECS.pop()


def test_data_source_reads_and_writes(spark, tmp_path):
    from rasterlake.sources.datasource import RasterSource

    spark.dataSource.register(RasterSource)
    rows = [(f"i{k}", bytearray(registry.encode(Picture([Frame(np.full((2, k + 1), SOLID | np.uint32(k)))]), "QOI"))) for k in range(5)]
    spark.createDataFrame(rows, "name string, content binary").write.format("raster").option("format", "qoi").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("raster").load(str(tmp_path / "out"))
    assert sorted((r.width, r.argb[0] & 255) for r in back.collect()) == [(k + 1, k) for k in range(5)]
    (tmp_path / "out" / "bad.qoi").write_bytes(b"qoif")
    bad = spark.read.format("raster").option("mode", "PERMISSIVE").load(str(tmp_path / "out")).filter("error is not null")
    assert bad.count() == 1


def jvm_pixels(spark, path):
    """A file's pixels by the decoders that come with the JVM."""
    jvm = spark._jvm
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(path)))
    w, h = picture.getWidth(), picture.getHeight()
    return np.array(list(picture.getRGB(0, 0, w, h, None, 0, w)), np.int32).view(np.uint32).reshape(h, w)


def test_jvm_reader_agrees(spark, tmp_path):
    p = next(x for i, x in enumerate(pictures()) if i == 2)
    (tmp_path / "a.png").write_bytes(plain.write_png(Picture([Frame(p)])))
    assert np.array_equal(jvm_pixels(spark, tmp_path / "a.png"), p)


def _quality(p, q):
    d = [np.stack([x >> s & 255 for s in (16, 8, 0)]).astype(float) for x in (p, q)]
    return 10 * np.log10(255**2 / max(1e-9, ((d[0] - d[1]) ** 2).mean()))


@pytest.mark.parametrize("quality,halve,least", [(0.75, True, 30), (0.95, False, 40), (1.0, False, 45)])
def test_jpeg(spark, tmp_path, quality, halve, least):
    p = next(x for i, x in enumerate(pictures()) if i == 1)
    data = jpeg.write_jpeg(Picture([Frame(p)], False), quality, halve)
    own = registry.decode(data).first
    assert registry.detect(data) == "JPEG" and _quality(p, own) > least
    (tmp_path / "a.jpg").write_bytes(data)
    assert _quality(own, jvm_pixels(spark, tmp_path / "a.jpg")) > 38


def test_jpeg_restarts_and_kinds():
    p = np.full((40, 40), 0xFF336699, np.uint32)
    data = bytearray(jpeg.write_jpeg(Picture([Frame(p)], False), 0.9))
    at = data.index(b"\xff\xc0")
    data[at + 1] = 0xC2
    with pytest.raises(UnsupportedFormat):
        jpeg.read_jpeg(bytes(data))
    with pytest.raises(DecodeError):
        jpeg.read_jpeg(b"\xff\xd8\xff")
