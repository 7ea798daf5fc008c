"""Spark data sources "raster_files" and "raster_pruned": picture files by their headers, and frames of those that pass.

``raster_files`` has one row for each file: ord, path, length, format, width, height, frames,
header_bytes (bytes read to know them), error.  ``raster_pruned`` has the frames of the
files, with ord.  With option ``pushdown`` = ``true`` (Spark's
``spark.sql.python.filterPushdown.enabled`` must be on) comparisons of path and length
decide before a file is opened, those of format, width, height and frames after its
header is read; only files that pass them all are decoded.

``load(folder)`` takes all files below a folder; the driver lists its first level,
tasks list the folders in it.  ``ord`` follows the paths.  Option ``paths``, a JSON list,
takes those files instead, and ``ord`` is their place in it.  Names that begin with _
or . are left out.  Option ``mode`` = ``PERMISSIVE`` gives damaged files a row with their error.
Rows leave as Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .datasource import _store
from .headers import Counted, read_header
from .model import RasterError
from .registry import _FRAME_NAMES, _FRAMES, _rows, decode

_FILES = "ord bigint, path string, length bigint, format string, width int, height int, frames int, header_bytes bigint, error string"
_FILES_ARROW = pa.schema([("ord", pa.int64()), ("path", pa.string()), ("length", pa.int64()), ("format", pa.string()), *((n, pa.int32()) for n in ("width", "height", "frames")), ("header_bytes", pa.int64()), ("error", pa.string())])
_TEXT, _FLAG = ("path", "disposal", "blend", "error"), "has_alpha"
_FRAMES_ARROW = pa.schema([("ord", pa.int64()), *((n, pa.string() if n in _TEXT else pa.bool_() if n == _FLAG else pa.list_(pa.int32()) if n == "argb" else pa.int32()) for n in _FRAME_NAMES)])
#: What can be told before a file is opened, and from its header.
_BEFORE, _HEADER = ("path", "length"), ("format", "width", "height", "frames")
_TESTS = {
    EqualTo: lambda v, w: v == w,
    EqualNullSafe: lambda v, w: v == w,
    GreaterThan: lambda v, w: v > w,
    GreaterThanOrEqual: lambda v, w: v >= w,
    LessThan: lambda v, w: v < w,
    LessThanOrEqual: lambda v, w: v <= w,
    In: lambda v, w: v in w,
    IsNotNull: lambda v, w: True,
}
_BATCH_ROWS, _BATCH_PIXELS = 4096, 1_000_000


class _Part(InputPartition):
    """Files (place, path) or one folder, whose places begin at ``first``."""

    def __init__(self, files: list[tuple[int, str]], folder: str | None = None, first: int = 0):
        self.files, self.folder, self.first = files, folder, first


def _passes(filters: list[tuple], row: dict) -> bool:
    """A value that is not known passes no comparison."""
    return all(row.get(column) is not None and test(row[column], value) for column, test, value in filters)


class FileReader(DataSourceReader):
    columns, schema = (*_BEFORE, *_HEADER), _FILES_ARROW

    def __init__(self, options: dict):
        self.root, self.paths = options.get("path"), json.loads(options["paths"]) if "paths" in options else None
        self.permissive, self.per_task = options.get("mode", "FAILFAST").upper() == "PERMISSIVE", int(options.get("filespertask", "64"))
        self.filters: list[tuple] = []

    def partitions(self) -> list[_Part]:
        from pyarrow import fs

        if self.paths is not None:
            files = list(enumerate(self.paths))
            return [_Part(files[k : k + self.per_task]) for k in range(0, len(files), self.per_task)]
        store, root = _store(self.root)
        found = store.get_file_info(root)
        if found.type == fs.FileType.File:
            return [_Part([(0, found.path)])]
        parts, files = [], []
        for n, info in enumerate(sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path)):
            if info.base_name.startswith(("_", ".")):
                continue
            if info.type == fs.FileType.Directory:
                parts.append(_Part([], info.path, n << 32))
            else:
                files.append((n << 32, info.path))
        return parts + [_Part(files[k : k + self.per_task]) for k in range(0, len(files), self.per_task)]

    def _files(self, part: _Part | None) -> Iterator[tuple[int, str, int, object]]:
        from pyarrow import fs

        if part is None:  # no files at all
            return
        store, _ = _store(self.root or (part.files[0][1] if part.files else "."))
        if part.folder is None:
            infos = [(k, store.get_file_info(p if "://" not in p else _store(p)[1])) for k, p in part.files]
        else:
            below = sorted(store.get_file_info(fs.FileSelector(part.folder, recursive=True)), key=lambda i: i.path)
            infos = [(part.first + k, i) for k, i in enumerate(b for b in below if b.type == fs.FileType.File and not b.base_name.startswith(("_", ".")))]
        for k, info in infos:
            yield k, info.path, info.size or 0, store

    def _heads(self, part: _Part) -> Iterator[tuple[dict, object]]:
        """Files that pass, with what their headers say, and where to open them."""
        before, after = [f for f in self.filters if f[0] in _BEFORE], [f for f in self.filters if f[0] in _HEADER]
        for k, path, size, store in self._files(part):
            row = {"ord": k, "path": path, "length": size}
            if not _passes(before, row):
                continue
            try:
                with store.open_input_file(path) as f:
                    counted = Counted(f, size)
                    row |= read_header(counted)._asdict() | {"header_bytes": counted.taken}
            except RasterError as e:
                if not self.permissive:
                    raise
                row["error"] = str(e)
            if _passes(after, row):
                yield row, store

    def _batches(self, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for row in rows:
            held.append(row)
            weight += len(row[12]) if len(row) > 12 and row[12] is not None else 0
            if len(held) >= _BATCH_ROWS or weight >= _BATCH_PIXELS:
                yield self._batch(held)
                held, weight = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)], schema=self.schema)

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield from self._batches(tuple(row.get(n) for n in self.schema.names) for row, _ in self._heads(partition))


class FrameReader(FileReader):
    columns, schema = ("path",), _FRAMES_ARROW

    def _frames(self, partition: _Part) -> Iterator[tuple]:
        for row, store in self._heads(partition):
            error = row.get("error")
            if not error:
                with store.open_input_stream(row["path"]) as f:
                    content = f.read()
                try:
                    yield from ((row["ord"], *r[:12], None) for r in _rows(row["path"], decode(content)))
                    continue
                except RasterError as e:
                    if not self.permissive:
                        raise
                    error = str(e)
            yield (row["ord"], row["path"], *[None] * 11, error)

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield from self._batches(self._frames(partition))


class _Pushed:
    """Takes the comparisons it can decide itself; Spark keeps the rest."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = _TESTS.get(type(f))
            if test is None or len(f.attribute) != 1 or f.attribute[0] not in self.columns:
                yield f
                continue
            self.filters.append((f.attribute[0], test, getattr(f, "value", None)))


class PushedFileReader(_Pushed, FileReader):
    pass


class PushedFrameReader(_Pushed, FrameReader):
    pass


class RasterFiles(DataSource):
    plain, pushed, rows = FileReader, PushedFileReader, _FILES

    @classmethod
    def name(cls) -> str:
        return "raster_files"

    def schema(self) -> str:
        return self.rows

    def reader(self, schema: StructType) -> FileReader:
        return (self.pushed if self.options.get("pushdown", "false").lower() == "true" else self.plain)({k.lower(): v for k, v in self.options.items()})


class RasterPruned(RasterFiles):
    plain, pushed, rows = FrameReader, PushedFrameReader, "ord bigint, " + _FRAMES

    @classmethod
    def name(cls) -> str:
        return "raster_pruned"
