"""Formats: detection, the codec registry, and bulk decode and encode of DataFrames.

Detection is a JVM-side expression; decoding and encoding run in Arrow tasks, one
row per file.  Readers and writers are looked up in order of registration, so an
added codec serves what the built-in ones do not claim.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg, lzw, plain, webp
from .model import DecodeError, EncodeError, Frame, Picture, RasterError, UnsupportedFormat
from .options import WriteOptions


class Codec(NamedTuple):
    format: str
    matches: Callable[[bytes], bool]
    read: Callable[[bytes], Picture] | None
    write: Callable[..., bytes] | None


def _begins(*marks: bytes) -> Callable[[bytes], bool]:
    return lambda d: d.startswith(marks)


_CODECS: list[Codec] = [
    Codec("JPEG", _begins(b"\xff\xd8\xff"), jpeg.read_jpeg, jpeg.write_jpeg),
    Codec("PNG", _begins(b"\x89PNG"), plain.read_png, plain.write_png),
    Codec("BMP", _begins(b"BM"), plain.read_bmp, plain.write_bmp),
    Codec("GIF", _begins(b"GIF"), lzw.read_gif, lzw.write_gif),
    Codec("WEBP", lambda d: d[:4] == b"RIFF" and d[8:12] == b"WEBP", webp.read_webp, webp.write_webp),
    Codec("TIFF", _begins(b"II*\0", b"MM\0*"), lzw.read_tiff, lzw.write_tiff),
    Codec("ICO", _begins(b"\0\0\1\0"), plain.read_ico, plain.write_ico),
    Codec("TGA", lambda d: len(d) >= 26 and d[-18:] == plain.TGA_FOOTER[8:], plain.read_tga, plain.write_tga),
    Codec("QOI", _begins(b"qoif"), plain.read_qoi, plain.write_qoi),
    Codec("PNM", lambda d: len(d) >= 2 and d[:1] == b"P" and d[1:2] in b"123456", plain.read_pnm, plain.write_pnm),
]


def register(codec: Codec) -> None:
    _CODECS.append(codec)


def formats() -> list[str]:
    return list(dict.fromkeys(c.format for c in _CODECS))


def detect(data: bytes) -> str:
    for c in _CODECS:
        if c.matches(data):
            return c.format
    raise UnsupportedFormat("no known format begins like this")


def decode(data: bytes, format: str | None = None) -> Picture:
    format = format or detect(data)
    for c in _CODECS:
        if c.format == format and c.read:
            try:
                return c.read(data)
            except RasterError:
                raise
            except Exception as e:  # whatever a parser trips over in damaged bytes
                raise DecodeError(f"damaged {format} file: {type(e).__name__}: {e}") from e
    raise UnsupportedFormat(f"nothing reads {format}")


def encode(picture: Picture, format: str | WriteOptions, **options) -> bytes:
    """A file in a format, or as write options say."""
    if isinstance(format, WriteOptions):
        format, options = format.format, format.arguments() | options
    for c in _CODECS:
        if c.format == format.upper() and c.write:
            return c.write(picture, **options)
    raise UnsupportedFormat(f"nothing writes {format}")


# -- columns ---------------------------------------------------------------------------


def format_of(content: Column) -> Column:
    """Format of a binary column, null if unknown; the same tests in the same order."""
    head = lambda n, start=1: F.hex(F.substring(content, start, n))
    footer = F.hex(F.substring(content, -18, 18)) == plain.TGA_FOOTER[8:].hex().upper()
    kinds = (
        F.when(head(3) == "FFD8FF", "JPEG")
        .when(head(4) == "89504E47", "PNG")
        .when(head(2) == "424D", "BMP")
        .when(head(3) == "474946", "GIF")
        .when((head(4) == "52494646") & (head(4, 9) == "57454250"), "WEBP")
        .when(head(4).isin("49492A00", "4D4D002A"), "TIFF")
        .when(head(4) == "00000100", "ICO")
        .when((F.length(content) >= 26) & footer, "TGA")
        .when(head(4) == "716F6966", "QOI")
        .when(head(2).between("5031", "5036"), "PNM")
    )
    return kinds


_FRAMES = "path string, frame_idx int, width int, height int, delay_ms int, offset_x int, offset_y int, disposal string, blend string, has_alpha boolean, loop_count int, argb array<int>, error string"
_FRAME_NAMES = [c.split()[0] for c in _FRAMES.split(", ")]


def _rows(path: str, picture: Picture) -> Iterator[tuple]:
    for k, f in enumerate(picture.frames):
        yield path, k, f.width, f.height, f.delay_ms, f.x, f.y, f.disposal, f.blend, picture.has_alpha, picture.loop_count, f.argb.astype(np.uint32).view(np.int32).ravel(), None


def decode_files(blobs: DataFrame, permissive: bool = False) -> DataFrame:
    """(path, content) -> one row per frame; with ``permissive`` a bad file gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = list(_rows(path, decode(bytes(content))))
                except RasterError as e:
                    if not permissive:
                        raise type(e)(f"{path}: {e}") from e
                    rows = [(path, *[None] * 11, str(e))]
                yield pd.DataFrame(rows, columns=_FRAME_NAMES)

    return blobs.select("path", "content").mapInPandas(run, _FRAMES)


def encode_frames(frames: DataFrame, format: str | WriteOptions, key: str = "picture_id", **options) -> DataFrame:
    """Frames (key, frame_idx, width, height, argb and perhaps delay_ms ..) -> (key, format, content), one file per key."""
    if isinstance(format, WriteOptions):
        format, options = format.format, format.arguments() | options
    format = format.upper()


    def frame(r, names: tuple) -> Frame:
        get = lambda n, other: other if n not in names or pd.isna(getattr(r, n)) else getattr(r, n)
        argb = np.asarray(r.argb, np.int32).view(np.uint32)
        if len(argb) != r.width * r.height:
            raise EncodeError(f"{len(argb)} colours for {r.width}x{r.height}")
        return Frame(argb.reshape(r.height, r.width), int(get("delay_ms", 0)), int(get("offset_x", 0)), int(get("offset_y", 0)), get("disposal", "NONE"), get("blend", "SOURCE"))

    def file(key_value, rows: list, names: tuple) -> tuple:
        alpha = bool(rows[0].has_alpha) if "has_alpha" in names else True
        return key_value, format, encode(Picture([frame(r, names) for r in rows], alpha), format, **options)

    columns, schema = [key, "format", "content"], f"{key} {dict(frames.dtypes)[key]}, format string, content binary"
    if "frame_idx" not in frames.columns:  # a row is a whole picture: no shuffle

        def stills(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                names = tuple(batch.columns)
                yield pd.DataFrame([file(getattr(r, key), [r], names) for r in batch.itertuples(index=False)], columns=columns)

        return frames.mapInPandas(stills, schema)

    def animation(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx")
        return pd.DataFrame([file(rows[key].iloc[0], list(rows.itertuples(index=False)), tuple(rows.columns))], columns=columns)

    return frames.groupBy(key).applyInPandas(animation, schema)


def decode_base64(texts: DataFrame, column: str = "content", permissive: bool = False) -> DataFrame:
    """Frames of files given as Base64 text."""
    return decode_files(texts.withColumn("content", F.unbase64(column)), permissive)


def to_base64(files: DataFrame) -> DataFrame:
    """The content column as Base64 text without line breaks."""
    return files.withColumn("content", F.regexp_replace(F.base64("content"), "[\\r\\n]", ""))


def read_files(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """Frames of all files under a path, through Spark's own file source."""
    return decode_files(spark.read.format("binaryFile").load(path), permissive)

