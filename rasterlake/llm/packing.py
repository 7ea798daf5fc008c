"""Packing of token sequences: first-fit decreasing over a tournament tree, in randomised groups.

A document's ids (its text's, then the end id) are cut into pieces of the
sequence length; all but the last are sequences already.  The last pieces are
dealt into groups at random (by a hash of document and place) and each group is
packed alone, so the work is linear in the input and no task ever sees more than
about ``GROUP_PIECES`` pieces, whatever the input.  Within a group pieces go in
order of falling length into the first open bin with room; a tournament tree
whose inner nodes hold the larger free capacity of their children finds that bin
in log(bins) steps.

Edge cases.  Null and empty texts: one piece with the end id alone.  Very long
texts: many full pieces, spread over the groups.  Repeated rows and equal ids:
each row is packed as its own document.  Null ids: kept as null.  Ties in length
are broken by doc_id, place and checksum.  No rows: none.  Other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, trimmed, written
from .wordbpe import encoder

#: Pieces of one packing group, on average.
GROUP_PIECES = 1000
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, row_no bigint"
_PACKED = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")])


@trimmed
def cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document, with their checksums."""
    enc = encoder(tokenizer)
    for batch in batches:
        ids, ends = enc.encode(batch.column("text"))
        ids = np.insert(ids, ends, np.uint32(end_id)).astype("<u4")
        ends = ends + np.arange(1, len(ends) + 1)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        tokens = ends - begins
        n = -(-tokens // capacity)
        row = np.repeat(np.arange(len(tokens)), n)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
        length = np.minimum(tokens[row] - start, capacity)
        at, raw = (begins[row] + start) * 4, memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(at.tolist(), (length * 4).tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row]), pa.array(row.astype(np.int64))],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_no"],
        )


class TournamentTree:
    """Free capacity of bins, first to last; ``first(size)`` is the first bin with so much room, or -1."""

    def __init__(self, bins: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [0] * (2 * self.leaves)

    def set(self, b: int, room: int) -> None:
        free, i = self.free, b + self.leaves
        free[i] = room
        i >>= 1
        while i:
            best = free[2 * i] if free[2 * i] >= free[2 * i + 1] else free[2 * i + 1]
            if free[i] == best:
                break
            free[i] = best
            i >>= 1

    def first(self, size: int) -> int:
        free, i = self.free, 1
        if free[1] < size:
            return -1
        while i < self.leaves:
            i = 2 * i if free[2 * i] >= size else 2 * i + 1
        return i - self.leaves


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length; lengths in falling order."""
    tree, bins, where, offset = TournamentTree(len(lengths)), 0, [], []
    for size in lengths:
        b = tree.first(size)
        if b < 0:
            b, room = bins, capacity
            bins += 1
        else:
            room = tree.free[b + tree.leaves]
        where.append(b)
        offset.append(capacity - room)
        tree.set(b, room - size)
    return where, offset


def pack_group(key: tuple, pieces: pa.Table, capacity: int) -> pa.Table:
    pieces = pieces.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    where, offset = first_fit_decreasing(pieces.column("length").to_pylist(), capacity)
    where = np.array(where, np.int64)
    filled = np.bincount(where, weights=pieces.column("length").to_numpy()).astype(np.int64)
    group = key[0].as_py()
    cols = [pieces.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    return pa.Table.from_arrays([*cols, pa.array((group << 32) + where), pa.array(offset, pa.int64()), pa.array(filled[where])], schema=_PACKED)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens (the filled part of the sequence)."""
    pieces = id_and_text(docs).mapInArrow(lambda it: cut(it, tokenizer, end_id, capacity), _PIECES)
    pieces = written(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("group_id", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row_no"), F.lit(groups)))
    schema = ", ".join(f"{f.name} bigint" for f in _PACKED)
    return dealt.groupBy("group_id").applyInArrow(lambda key, table: pack_group(key, table, capacity), schema)
