"""Header-only reads and filters that reach the file source."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.sources import files, headers, registry
from rasterlake.sources.model import Frame, Picture, RasterError

SIZES = {"PNG": (7, 5), "BMP": (9, 4), "GIF": (6, 6), "QOI": (3, 8), "PNM": (5, 2), "TGA": (4, 7), "TIFF": (8, 3), "ICO": (16, 16), "WEBP": (11, 6), "JPEG": (20, 12)}


def picture(w, h, n=1):
    return Picture([Frame(np.full((h, w), 0xFF000000 | 0x102030 * (k + 1), np.uint32), delay_ms=20) for k in range(n)])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    (root / "deep" / "deeper").mkdir(parents=True)
    for k, (format, (w, h)) in enumerate(SIZES.items()):
        where = root / ("deep/deeper" if k % 3 == 0 else "deep" if k % 3 == 1 else ".")
        (where / f"{k}.{format.lower()}").write_bytes(registry.encode(picture(w, h), format))
    for name, format in (("anim.gif", "GIF"), ("anim.webp", "WEBP"), ("pages.tiff", "TIFF")):
        (root / name).write_bytes(registry.encode(picture(10, 10, 3), format))
    (root / "large.bmp").write_bytes(registry.encode(picture(300, 200), "BMP"))
    (root / "_hidden.png").write_bytes(b"x")
    return root


@pytest.fixture(scope="module")
def source(spark):
    for c in (files.RasterFiles, files.RasterPruned):
        spark.dataSource.register(c)
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    yield spark
    spark.conf.set(name, before)


def test_headers_without_decoding(source, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in source.read.format("raster_files").load(str(folder)).collect()}
    assert len(rows) == len(SIZES) + 4
    for k, (format, size) in enumerate(SIZES.items()):
        r = rows[f"{k}.{format.lower()}"]
        assert (r.format, r.width, r.height, r.frames, r.error) == (format, *size, 1, None)
    assert [rows[n].frames for n in ("anim.gif", "anim.webp", "pages.tiff")] == [3, 3, 3]
    big = rows["large.bmp"]
    assert big.length > 100_000 and big.header_bytes < 100


def test_order_of_paths_and_of_a_list(source, folder):
    rows = source.read.format("raster_files").load(str(folder)).orderBy("ord").collect()
    assert len({r.ord for r in rows}) == len(rows)
    inside = [r.path for r in rows if "/deep/" in r.path]
    assert inside == sorted(inside)
    wanted = [str(folder / "large.bmp"), str(folder / "anim.gif"), str(folder / "large.bmp")]
    got = source.read.format("raster_files").option("paths", json.dumps(wanted)).load().orderBy("ord").collect()
    assert [(r.ord, r.path) for r in got] == list(enumerate(wanted))


def test_filters_reach_the_files(source, folder, monkeypatch):
    pruned = source.read.format("raster_pruned").option("pushdown", "true").load(str(folder))
    found = source.read.format("raster_files").option("pushdown", "true").load(str(folder))
    wanted = (F.col("format") == "BMP") & (F.col("width") > 100)
    df = found.filter(wanted)
    # nothing is left for Spark to filter after the scan
    filters = lambda d: d._jdf.queryExecution().executedPlan().toString().count(" Filter ")
    assert filters(df) == 0 and filters(source.read.format("raster_files").load(str(folder)).filter(wanted)) == 1
    assert [(r.width, r.height) for r in df.collect()] == [(300, 200)]
    assert found.filter(F.col("length") < 0).count() == 0
    assert found.filter(F.col("format").isin("GIF", "QOI") & (F.col("frames") >= 1)).count() == 3
    assert found.filter((F.col("width") + F.col("height")) == 12).count() == source.read.format("raster_files").load(str(folder)).filter((F.col("width") + F.col("height")) == 12).count()
    one = pruned.filter(F.col("path") == str(folder / "anim.gif"))
    assert [r.frame_idx for r in one.orderBy("frame_idx").collect()] == [0, 1, 2]


def test_only_what_passes_is_opened(folder, monkeypatch):
    """The same reader as on the executors, with counts of what it reads."""
    opened = []

    def counted(content):
        opened.append(len(content))
        return registry.decode(content)

    monkeypatch.setattr(files, "decode", counted)
    reader = files.PushedFrameReader({"path": str(folder)})
    reader.columns = (*files._BEFORE, *files._HEADER)
    assert list(reader.pushFilters([files.EqualTo(("format",), "QOI"), files.LessThan(("height",), 100)])) == []
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(len(b) for b in rows) == 1 and len(opened) == 1
    other = files.PushedFileReader({"path": str(folder)})
    odd = files.EqualTo(("error",), "x")
    assert list(other.pushFilters([odd, files.GreaterThan(("length",), 10)])) == [odd]


def test_damaged_files(source, tmp_path):
    (tmp_path / "a.gif").write_bytes(b"GIF89a\x05\x00\x05")
    (tmp_path / "b.bin").write_bytes(b"nothing known")
    (tmp_path / "c.qoi").write_bytes(registry.encode(picture(2, 2), "QOI")[:18])
    rows = {r.path[-5:]: r for r in source.read.format("raster_files").option("mode", "PERMISSIVE").load(str(tmp_path)).collect()}
    assert rows["a.gif"].error and rows["b.bin"].error and rows["c.qoi"].width == 2
    frames = source.read.format("raster_pruned").option("mode", "PERMISSIVE").load(str(tmp_path)).collect()
    assert len(frames) == 3 and all(r.error for r in frames)
    with pytest.raises(RasterError):
        headers.read_header(headers.Counted(open(tmp_path / "a.gif", "rb"), 9))
    with pytest.raises(Exception):
        source.read.format("raster_files").load(str(tmp_path)).collect()
    assert source.read.format("raster_files").option("paths", "[]").load().count() == 0


def test_a_write_of_another_count_leaves_nothing(spark, tmp_path):
    from rasterlake.sources.datasource import RasterSource

    spark.dataSource.register(RasterSource)
    rows = [(f"i{k}", bytearray(registry.encode(picture(2, 2), "QOI"))) for k in range(3)]
    df = spark.createDataFrame(rows, "name string, content binary")
    write = lambda n: df.write.format("raster").option("format", "qoi").option("expected", n).mode("append").save(str(tmp_path / f"out{n}"))
    write(3)
    assert len(list((tmp_path / "out3").glob("*.qoi"))) == 3
    with pytest.raises(Exception, match="were expected"):
        write(4)
    assert not list((tmp_path / "out4").glob("*.qoi"))
