"""Removes repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

The texts are written once as a table bucketed by *block* (about 8 MB of text).
Later steps meet each block's texts through that bucketing, so texts are never
shuffled.  Every window of ``size`` words has a polynomial hash over 64-bit hashes of
its words, in two independent versions, 128 bits together.

1.  Each block sends the first 48 bits of its windows' hashes, distinct and sorted, to
    ranges of hashes.  A range counts them and answers with one bit each: in more than
    one block or not.  A passage that a block repeats, however often, is sent once.
2.  For windows so marked a block sends all 128 bits and its smallest doc_id that has
    the window.  A range answers with one bit each: first of all or not.
3.  A block now knows which of its windows start earlier somewhere.  They merge into
    maximal intervals of removed words.

Ranges follow the size of the corpus, about ``RANGE_WINDOWS`` windows each.  A hash
that is everywhere costs one entry for each block, so nothing is hot.

Edge cases.  Null texts are empty: no words, nothing removed.  Fewer words than a
window: nothing removed.  Overlapping repeats inside one text count ("a a a ...").
Null doc_ids come before all others.  Rows of equal doc_ids (repeated rows) rank as
they are stored: the later one is a repeat of the earlier one.  A very long text is
a block of its own.  No rows: none.  Other columns are not read, so their names
cannot clash.  Different windows would have to agree in 128 bits to be taken for
equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, new_folder, trimmed, words, written

BLOCK_BYTES, RANGE_WINDOWS = 8_000_000, 2_000_000
#: Odd multipliers of the two polynomials.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SHORT = np.uint64(16)  # bits of the first hash that the first step leaves out
_TEXTS = "block bigint, at int, size bigint, doc_id bigint, text string"
_SENT = "block bigint, range bigint, rows bigint, first binary, second binary, ids binary"
_BITS = "block bigint, step int, range bigint, rows bigint, bits binary"
_KEPT = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept string"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_NO_ID = np.iinfo(np.int64).min


@trimmed
def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text, part) with the block that each belongs to and its number there."""
    block = at = held = 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        blocks, ats = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int32)
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > BLOCK_BYTES:
                block, at, held = block + 1, 0, 0
            blocks[i], ats[i] = block, at
            at, held = at + 1, held + n
        if len(sizes):
            blocks += batch.column("part")[0].as_py() << 32
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(ats), pa.array(sizes), batch.column("doc_id"), batch.column("text")], names=["block", "at", "size", "doc_id", "text"])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, compressed; the high planes of small numbers take no room."""
    planes = np.ascontiguousarray(values, values.dtype.newbyteorder("<")).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, rows: int, dtype=np.uint64) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=rows * np.dtype(dtype).itemsize, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, rows).T).view(dtype).reshape(-1)


def rolled(w: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of all runs of ``size`` entries, from runs of powers of two."""
    n, total = len(w) - size + 1, np.zeros(max(len(w) - size + 1, 0), np.uint64)
    if n <= 0:
        return total
    run, span, done = w, 1, 0
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    while True:
        if size & span:
            total = total * power(span) + run[done : done + n]
            done += span
        if 2 * span > size:
            return total
        run = run[:-span] * power(span) + run[span:]
        span *= 2


class Windows:
    """The windows of one block, documents in order of (doc_id, place)."""

    def __init__(self, table: pa.Table, size: int):
        ids = pc.fill_null(table.column("doc_id"), _NO_ID).to_numpy()
        order = np.lexsort((table.column("at").to_numpy(), ids))
        self.size, self.ids = size, ids[order]
        self.doc_ids = table.column("doc_id").take(pa.array(order)).combine_chunks()
        texts = table.column("text").take(pa.array(order)).cast(pa.large_string()).combine_chunks()
        self.codes, self.ends, self.words = words(texts, lower=False)
        digests = [xxhash.xxh3_128_intdigest(w.as_buffer()) for w in self.words] if len(self.codes) else []
        halves = [np.array([d >> s & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64) for s in (0, 64)]
        self.starts = np.concatenate([[0], self.ends[:-1]])
        n = np.diff(self.ends, prepend=0)
        left = np.repeat(self.ends, n) - np.arange(len(self.codes))
        self.at = np.flatnonzero(left >= size)  # the first word of each window
        self.first, self.second = (rolled(h[self.codes], size, b)[self.at] if len(self.at) else np.zeros(0, np.uint64) for h, b in zip(halves, _BASES))
        by = np.argsort(self.first, kind="stable")
        short = (self.first >> _SHORT)[by]
        new = np.concatenate([[True], short[1:] != short[:-1]]) if len(short) else np.zeros(0, bool)
        self.short = short[new]
        self.group = np.empty(len(by), np.int64)  # of each window, its place among the distinct short hashes
        self.group[by] = np.cumsum(new) - 1

    def repeats(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows that may repeat, equal ones together and in order; whether each is the first of its kind here; whether it is marked)."""
        often = np.bincount(self.group, minlength=len(self.short)) > 1
        w = np.flatnonzero((marked | often)[self.group])
        w = w[np.lexsort((self.second[w], self.first[w]))]
        a, b = self.first[w], self.second[w]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(w) else np.zeros(0, bool)
        return w, new, marked[self.group[w]]

    def document(self, w: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, self.at[w], "right")

    def cut(self, gone: np.ndarray) -> pa.Table:
        """The block's documents without the words of the windows ``gone``."""
        edge = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(edge, self.at[gone], 1)
        np.add.at(edge, self.at[gone] + self.size, -1)
        out = np.cumsum(edge)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(out)])
        n_words, n_out = self.ends - self.starts, before[self.ends] - before[self.starts]
        flips = np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))
        inner = np.intersect1d(self.starts[self.starts < len(out)], np.flatnonzero(out))  # an interval ends with its document
        a = np.union1d(np.flatnonzero(flips == 1), inner)
        b = np.union1d(np.flatnonzero(flips == -1), inner[inner > 0][out[inner[inner > 0] - 1]]) if len(out) else a
        row = np.searchsorted(self.ends, a, "right")
        spans = pa.StructArray.from_arrays([pa.array((a - self.starts[row]).astype(np.int32)), pa.array((b - self.starts[row]).astype(np.int32))], names=["start", "end"])
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(self.ends)))]).astype(np.int32)
        kept = self.words.take(pa.array(self.codes[~out]))
        ends = pa.array(np.concatenate([[0], self.ends - before[self.ends]]).astype(np.int64))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(ends, kept.cast(pa.string())), " ")
        return pa.table([self.doc_ids, pa.array(n_words), pa.array(n_out), pa.ListArray.from_arrays(pa.array(bounds), spans).cast(_SPAN), texts.cast(pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept"])


def ranges(hashes: np.ndarray, bits: int, of: int = 64) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted hashes by their first ``bits``."""
    top = hashes >> np.uint64(of - bits) if bits else np.zeros(len(hashes), np.uint64)
    at = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(top) else np.zeros(0, int)
    yield from zip(top[at].tolist(), at.tolist(), [*at[1:].tolist(), len(top)])


def _sent(block: int, rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3
    columns = list(zip(*((block, *r) for r in rows))) if rows else [[]] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "range", "rows", "first", "second", "ids"])


def _answers(step: int, table: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    blobs = [pa.compress(np.packbits(b).tobytes(), codec="zstd", asbytes=True) for b in bits]
    return pa.table([table.column("block"), pa.array([step] * len(bits), pa.int32()), table.column("range"), table.column("rows"), pa.array(blobs, pa.binary())], names=["block", "step", "range", "rows", "bits"])


def _read_answers(table: pa.Table, step: int) -> np.ndarray:
    """The bits of one step in order of the hashes: ranges follow each other."""
    rows = sorted((r for r in table.to_pylist() if r["step"] == step), key=lambda r: r["range"])
    bits = [np.unpackbits(np.frombuffer(pa.decompress(r["bits"], decompressed_size=-(-r["rows"] // 8), codec="zstd"), np.uint8), count=r["rows"]) for r in rows]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


@trimmed
def _returned(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    yield from tables


def of_one(f):
    """A function of one table that returns freed memory at its end."""
    return lambda table: list(_returned(f(t) for t in [table]))[0]


def of_two(f):
    return lambda table, other: list(_returned(f(table, t) for t in [other]))[0]


def first_step(size: int, bits: int):
    def send(table: pa.Table) -> pa.Table:
        w = Windows(table, size)
        rows = [(r, b - a, packed(np.diff(w.short[a:b], prepend=np.uint64(0))), b"", b"") for r, a, b in ranges(w.short, bits, 48)]
        return _sent(table.column("block")[0].as_py(), rows)

    return of_one(send)


@of_one
def counted(table: pa.Table) -> pa.Table:
    """A range of the first step: which hashes came from more than one block."""
    lists = [np.cumsum(unpacked(b, n), dtype=np.uint64) for b, n in zip(table.column("first").to_pylist(), table.column("rows").to_pylist())]
    every = np.sort(np.concatenate(lists))
    twice = every[1:][every[1:] == every[:-1]]
    return _answers(1, table, [twice[np.minimum(np.searchsorted(twice, x), len(twice) - 1)] == x if len(twice) else np.zeros(len(x), bool) for x in lists])


def second_step(size: int, bits: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _sent(0, [])
        w = Windows(table, size)
        at, new, marked = w.repeats(_read_answers(answers, 1))
        own = at[new & marked]
        a, b, ids = w.first[own], w.second[own], w.ids[w.document(own)]
        rows = [(r, k - j, packed(np.diff(a[j:k], prepend=np.uint64(0))), packed(b[j:k]), packed(ids[j:k])) for r, j, k in ranges(a, bits)]
        return _sent(table.column("block")[0].as_py(), rows)

    return of_two(send)


@of_one
def firsts(table: pa.Table) -> pa.Table:
    """A range of the second step: which block has a window first, by (doc_id, block)."""
    rows = table.column("rows").to_pylist()
    a = np.concatenate([np.cumsum(unpacked(x, n), dtype=np.uint64) for x, n in zip(table.column("first").to_pylist(), rows)])
    b = np.concatenate([unpacked(x, n) for x, n in zip(table.column("second").to_pylist(), rows)])
    ids = np.concatenate([unpacked(x, n, np.int64) for x, n in zip(table.column("ids").to_pylist(), rows)])
    blocks = np.repeat(table.column("block").to_numpy(), rows)
    order = np.lexsort((b, a))
    a, b, ids, blocks = a[order], b[order], ids[order], blocks[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    n = np.diff(np.concatenate([at, [len(a)]]))
    least = ids == np.repeat(np.minimum.reduceat(ids, at), n)
    blocks = np.where(least, blocks, np.iinfo(np.int64).max)
    own = np.empty(len(a), bool)
    own[order] = least & (blocks == np.repeat(np.minimum.reduceat(blocks, at), n))
    return _answers(2, table, np.split(own, np.cumsum(rows)[:-1]))


def last_step(size: int):
    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        w = Windows(table, size)
        at, new, marked = w.repeats(_read_answers(answers, 1))
        stays = new & ~marked
        stays[new & marked] = _read_answers(answers, 2)
        return w.cut(at[~stays])

    return of_two(cut)


def bucketed(rows: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by ``key``: grouping by it again needs no shuffle."""
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    rows.write.format("parquet").bucketBy(buckets, key).option("path", new_folder(spark, name)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def without_repeats(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, removed (intervals of words, end exclusive), kept (the other words, joined by spaces)."""
    spark = docs.sparkSession
    read = id_and_text(docs, id_col, text_col)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(read.rdd.getNumPartitions(), 50_000))
    texts = bucketed(read.withColumn("part", F.spark_partition_id().cast("bigint")).mapInArrow(in_blocks, _TEXTS), "block", buckets, "passages")
    total = texts.agg(F.sum("size")).first()[0] or 0
    bits = max(0, (total // 6 // RANGE_WINDOWS)).bit_length()
    by_block = texts.groupBy("block")
    sent = by_block.applyInArrow(first_step(size, bits), _SENT)
    seen = written(sent.groupBy("range").applyInArrow(counted, _BITS), "seen")
    sent = by_block.cogroup(seen.groupBy("block")).applyInArrow(second_step(size, bits), _SENT)
    answers = seen.unionByName(written(sent.groupBy("range").applyInArrow(firsts, _BITS), "firsts"))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(last_step(size), _KEPT)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same digests by comparing windows as strings.
REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i : i + 19], ' ') END AS win FROM t),
m AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, r, i) > 1 AS again FROM k),
c AS (SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM m),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""
