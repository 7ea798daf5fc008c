"""Token ids in wavelet-matrix files: one compressed, searchable file per shard.

A file holds the ids of a run of documents.  Plane b of the matrix has bit b of
every id, where from plane to plane the ids with a 0 bit move before those with
a 1 bit, each keeping their order.  With counts of ones per block each plane
answers rank in constant time; from that follow, without unpacking the ids:
``access(i)``, ``count(id, i, j)`` and ``select(id, k)`` (place of the k-th).

Documents go into the files in ascending doc_id order.  Spark range-partitions
them by doc_id (a sample of ids sets the bounds), each partition is a shard: its
documents are sorted, encoded and written to the shared folder under a name that
depends only on the shard, through a temporary name, so a repeated or speculative
task writes the same file again.

Edge cases.  Null and empty texts: the end id alone.  Null doc_ids: before all
others, kept as null.  Equal doc_ids and repeated rows: next to each other, each
its own document.  Very long texts: a file of their own if need be.  Ties in
doc_id go by a hash of the text.  No rows: no files, no result rows.  Other columns
are not read, so their names cannot clash.  An id that does not fit the planes is an
error, never cut.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, new_folder, trimmed, written
from .wordbpe import encoder

MAGIC = b"WMX1"
#: Documents of a shard, on average, and ids of a file, at most (or one document).
SHARD_DOCS, FILE_TOKENS = 8192, 2_000_000
_BLOCK = 512  # bits between stored counts


class WaveletMatrix:
    """Bit planes of a sequence of unsigned integers, most significant first."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.bits, self.planes, self.zeros, self.ranks = n, bits, planes, zeros, ranks

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        if len(values) and not 0 <= int(values.min()) <= int(values.max()) < 1 << bits:
            raise ValueError(f"an id does not fit {bits} bits")
        v, n = values.astype(np.uint16 if bits <= 16 else np.uint32), len(values)
        planes, zeros, ranks = [], [], []
        for b in range(bits - 1, -1, -1):
            one = (v & v.dtype.type(1 << b)) != 0
            packed = np.packbits(one)
            planes.append(packed)
            ranks.append(cls._counts(packed))
            v = np.concatenate([v[~one], v[one]])
            zeros.append(n - int(np.count_nonzero(one)))
        return cls(n, bits, planes, zeros, ranks)

    @staticmethod
    def _counts(packed: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        step = _BLOCK // 8
        per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), step), dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
        return np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)

    def rank(self, plane: int, i: int) -> int:
        """Ones before place i."""
        block, p = i // _BLOCK, self.planes[plane]
        byte, bit = i // 8, i % 8
        n = int(self.ranks[plane][block]) + int(np.bitwise_count(p[block * _BLOCK // 8 : byte]).sum())
        return n + (int(p[byte] >> (8 - bit)).bit_count() if bit else 0)

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i // 8] >> (7 - i % 8)) & 1

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self.rank(k, i)
            value, i = value * 2 + bit, (self.zeros[k] + ones if bit else i - ones)
        return value

    def _descend(self, value: int, i: int, j: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self.rank(k, i), self.rank(k, j)
            i, j = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (i - a, j - b)
        return i, j

    def count(self, value: int, i: int = 0, j: int | None = None) -> int:
        a, b = self._descend(value, i, self.n if j is None else j)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0), or -1."""
        i, j = self._descend(value, 0, self.n)
        if k >= j - i:
            return -1
        at = i + k
        for p in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - p) & 1
            want, lo, hi = (at - self.zeros[p] if one else at), 0, self.n
            while lo < hi:  # first place with more than `want` such bits up to and with it
                mid = (lo + hi) // 2
                have = self.rank(p, mid + 1)
                if (have if one else mid + 1 - have) > want:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at

    def values(self) -> np.ndarray:
        """All values in order: from the last plane up, each step undoes one stable split."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[~one] = v[: self.zeros[k]]
            up[one] = v[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            v = up
        return v


def file_bytes(shard: int, number: int, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """Magic, header, compressed table of documents, then each compressed plane and its counts."""
    wm, z = WaveletMatrix.build(ids, bits), zstandard.ZstdCompressor(level=1)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [z.compress(known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + sizes.astype("<i8").tobytes())]
    for k in range(bits):
        parts += [z.compress(wm.planes[k].tobytes()), z.compress(wm.ranks[k].astype("<u4").tobytes())]
    head = struct.pack("<4sqqqqi", MAGIC, shard, number, len(doc_ids), len(ids), bits)
    return head + struct.pack(f"<{bits}q", *wm.zeros) + struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


def read_file(content: bytes) -> tuple[int, int, list[int | None], np.ndarray, WaveletMatrix]:
    """(shard, number in it, doc_ids, ids of each document, matrix)."""
    head = struct.calcsize("<4sqqqqi")
    magic, shard, number, docs, n, bits = struct.unpack_from("<4sqqqqi", content)
    if magic != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    zeros = list(struct.unpack_from(f"<{bits}q", content, head))
    lens = struct.unpack_from(f"<{2 * bits + 1}q", content, head + 8 * bits)
    at, parts, z = head + 8 * (3 * bits + 1), [], zstandard.ZstdDecompressor()
    for size in lens:
        parts.append(z.decompress(content[at : at + size]))
        at += size
    known = np.frombuffer(parts[0], np.uint8, docs)
    own = np.frombuffer(parts[0], "<i8", docs, docs)
    sizes = np.frombuffer(parts[0], "<i8", docs, 9 * docs)
    planes = [np.frombuffer(p, np.uint8) for p in parts[1::2]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[2::2]]
    return shard, number, [int(d) if k else None for d, k in zip(own, known)], sizes, WaveletMatrix(n, bits, planes, zeros, ranks)


def _store(folder: str):
    """(file system, path) of a folder that driver and tasks reach; pyarrow's name for S3 is taken where Hadoop has another."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))
    except pa.ArrowInvalid as e:
        raise ValueError(f"token files cannot be written to {folder}: {e}") from e


class _Shard:
    """Files of one shard: documents are added in order, files go out when full."""

    def __init__(self, folder: str, number: int, bits: int, file_tokens: int):
        self.store, self.root = _store(folder)
        self.shard, self.bits, self.most = number, bits, file_tokens
        self.files: list[tuple[int, int, int, int]] = []
        self.docs: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > self.most:
            self.flush()
        self.docs.append(doc)
        self.ids.append(ids)
        self.held += len(ids)

    def flush(self) -> None:
        if not self.docs:
            return
        sizes, number = np.array([len(x) for x in self.ids]), len(self.files)
        content = file_bytes(self.shard, number, self.docs, sizes, np.concatenate(self.ids), self.bits)
        part = f"{self.root}/_{uuid.uuid4().hex}"
        with self.store.open_output_stream(part) as f:
            f.write(content)
        self.store.move(part, f"{self.root}/{self.shard:08d}-{number:05d}.wmx")
        self.files.append((self.shard, number, len(self.docs), int(sizes.sum())))
        self.docs, self.ids, self.held = [], [], 0


@trimmed
def _write_files(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, bits: int, file_tokens: int) -> Iterator[pa.RecordBatch]:
    """A partition of documents in order of doc_id in, its files written; one row for each file."""
    shard, enc = _Shard(folder, TaskContext.get().partitionId(), bits, file_tokens), encoder(tokenizer)
    for batch in batches:
        ids, ends = enc.encode(batch.column("text"))
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for doc, x, y in zip(batch.column("doc_id").to_pylist(), begins.tolist(), ends.tolist()):
            shard.add(doc, np.append(ids[x:y], np.uint32(end_id)))
    shard.flush()
    if shard.files:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*shard.files)], names=["shard", "number", "docs", "tokens"])


@trimmed
def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document of each file: place before it in the file, number of ids, checksum."""
    for batch in batches:
        for content in batch.column("content"):
            shard, number, docs, sizes, wm = read_file(memoryview(content.as_buffer()))
            ends = np.cumsum(sizes)
            raw = memoryview(wm.values().astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(np.full(len(docs), shard)), pa.array(np.full(len(docs), number)), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "number", "place", "n_tokens", "ids_crc32"],
            )


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, bits: int | None = None, shard_docs: int = SHARD_DOCS, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files; one row for each: shard, number, docs, tokens, base (ids in all files before it).

    bits: planes of a matrix; as many as the vocabulary and the end id need if not given.
    """
    rows = id_and_text(docs)
    bits = bits or max(1, max(encoder(tokenizer).last_id, end_id).bit_length())
    shards = max(1, -(-rows.count() // shard_docs))
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # many rows with one id, or none, are many ranges
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    written_files = dealt.mapInArrow(lambda it: _write_files(it, folder, tokenizer, end_id, bits, file_tokens), "shard bigint, number bigint, docs bigint, tokens bigint")
    files = written(written_files, "files")
    # running totals in two steps, so that no window holds the files of more than about a thousand shards
    block = F.expr("shard div 1000")
    totals = files.groupBy(block.alias("block")).agg(F.sum("tokens").alias("t"))
    totals = totals.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("block").orderBy("shard", "number"))
    based = files.withColumn("block", block).withColumn("inside", inside - F.col("tokens")).join(totals, "block")
    return based.select("shard", "number", "docs", "tokens", (F.col("before") + F.col("inside")).alias("base"))


def read_token_files(spark, folder: str, files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.wmx").load(folder).select("content")
    docs = blobs.mapInArrow(_read_docs, "doc_id bigint, shard bigint, number bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(files.select("shard", "number", "base"), ["shard", "number"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    files = write_token_files(docs, tokenizer, folder, end_id)
    return read_token_files(spark, folder, files)
