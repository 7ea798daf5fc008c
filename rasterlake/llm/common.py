"""What the corpus operators share: the shared folder, written tables, reading, and word splitting."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset."""
    global _LOCAL_SHARED
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _LOCAL_SHARED = _LOCAL_SHARED or "file://" + tempfile.mkdtemp(prefix="corpus-")
        base = _LOCAL_SHARED
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, name: str) -> DataFrame:
    """``written`` for rows that come from a shuffle: at most four files a core, or one for sixteen shuffle partitions if that is more.

    Partitions of one task follow each other, so its memory is that of one; a table of few rows is not hundreds of files.
    """
    spark = df.sparkSession
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    return written(df.coalesce(most), name)


def trimmed(batches: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A generator over batches that returns freed memory to the system at its end: Spark keeps workers for later tasks."""

    @functools.wraps(batches)
    def run(*args, **kwargs):
        try:
            yield from batches(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc: nothing to return
                pass

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of one Arrow batch on its way to Python, where the session sets none; a longer row is a batch of its own.
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, not by rows alone: ten thousand long texts would not fit a worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what the operators read, so that other columns and their names cannot matter; a null text counts as empty."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(of: Column, parts: int) -> Column:
    """crc32 of the number as decimal text, modulo parts; a null id falls into fold 0."""
    return F.coalesce(F.crc32(of.cast("string").cast("binary")) % parts, F.lit(0))


_LOWER_AND_SPACE = np.arange(256, dtype=np.uint8)
_LOWER_AND_SPACE[65:91] += 32
_LOWER_AND_SPACE[9:14] = 32


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of runs of about so many bytes; one long text is a run of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        yield i, texts.slice(i, j - i)
        i = j


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def as_strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of characters other than space and \\x09-\\x0D, A-Z lower-cased: (code of each word, ends by row, distinct words)."""
    raw, offsets = buffers(texts)
    if lower:
        raw = _LOWER_AND_SPACE[raw]
    else:
        raw = np.where((raw >= 9) & (raw <= 13), np.uint8(32), raw)
    lists = pc.split_pattern(as_strings(raw, offsets), " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.dictionary_encode()
    codes = coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        full = codes != empty
        before = np.concatenate([[0], np.cumsum(full)])
        return codes[full], before[bounds[1:]], coded.dictionary
    return codes, bounds[1:], coded.dictionary
