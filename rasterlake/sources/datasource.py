"""Spark data source "raster": frames of picture files in, one file per picture out.

``spark.dataSource.register(RasterSource)``, then ``spark.read.format("raster").load(folder)``
gives one row per frame, and ``df.write.format("raster").option("format", "qoi").save(folder)``
writes a file for every row of (name, frames already encoded as content).  Files
appear under their final name only when the whole write is committed; with option
``expected``, only if they are so many.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .model import RasterError
from .registry import _FRAMES, _rows, decode


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str, permissive: bool, per_task: int):
        self.path, self.permissive, self.per_task = path, permissive, per_task

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(root)
        infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(i.path for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
        return [_Files(paths[k : k + self.per_task]) for k in range(0, len(paths), self.per_task)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                content = f.read()
            try:
                for row in _rows(path, decode(content)):
                    yield (*row[:11], row[11].tolist(), None)
            except RasterError as e:
                if not self.permissive:
                    raise
                yield (path, *[None] * 11, str(e))


class _Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, expected: int | None = None):
        self.path, self.suffix, self.expected = path, suffix, expected

    def write(self, rows: Iterator) -> _Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/_pending", recursive=True)
        moves = []
        for row in rows:
            held = f"{root}/_pending/{uuid.uuid4().hex}"
            with store.open_output_stream(held) as f:
                f.write(bytes(row["content"]))
            moves.append((held, f"{root}/{row['name']}{self.suffix}"))
        return _Written(moves)

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        written = sum(len(m.moves) for m in messages)
        if self.expected is not None and written != self.expected:
            raise ValueError(f"{written} files were written, {self.expected} were expected")
        for m in messages:
            for held, name in m.moves:
                store.move(held, name)
        store.delete_dir(f"{root}/_pending")

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in filter(None, messages):
            for held, _ in m.moves:
                store.delete_file(held)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return _FRAMES

    def reader(self, schema: StructType) -> _Reader:
        o = self.options
        return _Reader(o["path"], o.get("mode", "FAILFAST").upper() == "PERMISSIVE", int(o.get("filesPerTask", "16")))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        expected = self.options.get("expected")
        return _Writer(self.options["path"], "." + self.options.get("format", "bin").lower(), None if expected is None else int(expected))
