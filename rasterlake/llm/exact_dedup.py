"""Exact duplicates by tree-merge of sorted digest runs.

Every partition turns its rows into a sorted run of digests, one entry for each
distinct text it holds.  Partitions then exchange runs in binomial rounds with
fan-in 8: in each round eight neighbours form a node, every member gives each
other member one eighth of the digest range, and what a member receives is
merged.  After round r a member holds the merged entries of 8^r partitions over
1/8^r of the range, so every round moves each entry once and every task holds
about as much as one partition did, however many partitions there are.  Runs are
merged two by two in a tournament: binary searches of each run in the other give
the places of all entries, nothing is sorted again.  Each merge keeps, of equal
digests, the row that stays and the number of rows, and verifies that equal SHA-256
digests agree in the length and the XXH64 of the text too; if not, the job fails.
A group of copies, however large, is one entry from the first level on.

Edge cases.  Null text equals empty text.  Texts are equal when identical after
lower-casing A-Z only.  Of rows with equal texts and equal doc_ids (repeated
rows) exactly one stays.  Null doc_ids rank below all others when the largest
stays, above when the smallest stays; ``keep_id`` is then null.  Very long texts
are hashed whole.  No rows: none.  Other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, trimmed, written

#: Runs merged at once, as a power of two.
FAN_BITS = 3
#: Entries of one run row.
RUN_ROWS = 100_000
_DIGESTS = "doc_id bigint, row_id bigint, row_hash bigint, n_bytes bigint, mark bigint, digest binary"
_FIELDS = ("digests", "ids", "rows", "counts", "sizes", "marks")
_RUN = "node bigint, bucket bigint, " + ", ".join(f"{n} binary" for n in _FIELDS)
_RUN_ARROW = pa.schema([("node", pa.int64()), ("bucket", pa.int64()), *((n, pa.binary()) for n in _FIELDS)])
_GROUPS = "digest binary, keep_id bigint, keep_row bigint, group_size bigint"
_GROUPS_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_NO_ID = np.iinfo(np.int64).min
_DIGEST = "S32"  # compares byte by byte; digests have one length, so trailing zeros do not matter


class Run:
    """Sorted distinct digests with, for each: id and row of the one that stays, rows, text length, second hash."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, rows: np.ndarray, counts: np.ndarray, sizes: np.ndarray, marks: np.ndarray):
        self.digests, self.ids, self.rows, self.counts, self.sizes, self.marks = digests, ids, rows, counts, sizes, marks

    def __len__(self) -> int:
        return len(self.ids)

    def columns(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in _FIELDS]

    @classmethod
    def sorted(cls, *columns: np.ndarray) -> Run:
        """A run from rows in any order."""
        by_row = np.lexsort((columns[2], columns[1]))
        order = by_row[np.argsort(columns[0][by_row], kind="stable")]
        return cls._distinct([c[order] for c in columns])

    @classmethod
    def _distinct(cls, columns: list[np.ndarray]) -> Run:
        """One entry for each digest; equal ones stand together, the one that stays last."""
        d, i, r, c, s, m = columns
        if len(i) == 0:
            return cls(*columns)
        same = d[1:] == d[:-1]
        if (s[1:][same] != s[:-1][same]).any() or (m[1:][same] != m[:-1][same]).any():
            raise ValueError("different texts share a digest")
        at = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.concatenate([at[1:], [len(i)]]) - 1
        return cls(d[last], i[last], r[last], np.add.reduceat(c, at), s[last], m[last])

    def merge(self, other: Run) -> Run:
        """Two runs as one: each entry's place is its own plus that of its digest in the other run."""
        if not len(self) or not len(other):
            return self if len(self) else other
        a = np.arange(len(self)) + np.searchsorted(other.digests, self.digests, "left")
        b = np.arange(len(other)) + np.searchsorted(self.digests, other.digests, "right")
        columns = []
        for x, y in zip(self.columns(), other.columns()):
            out = np.empty(len(a) + len(b), x.dtype)
            out[a], out[b] = x, y
            columns.append(out)
        # of two equal digests the one that stays comes last
        d, i, r = columns[:3]
        first = np.flatnonzero(d[1:] == d[:-1])
        swap = first[(i[first] > i[first + 1]) | ((i[first] == i[first + 1]) & (r[first] > r[first + 1]))]
        for c in columns:
            c[swap], c[swap + 1] = c[swap + 1], c[swap].copy()
        return self._distinct(columns)

    @classmethod
    def merged(cls, runs: list[Run]) -> Run:
        """Multiway merge as a tournament of two-way merges."""
        while len(runs) > 1:
            runs = [runs[k].merge(runs[k + 1]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return runs[0]

    def rows_of(self, node: int, prefix: int, level: int) -> Iterator[list]:
        """Split by the next digit of the digest; the parts go to the members of the node one level up."""
        words = np.frombuffer(self.digests.tobytes(), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
        top = (words >> np.uint64(64 - FAN_BITS * (level + 1))).astype(np.int64)
        for digit in range(1 << FAN_BITS):
            bucket = (prefix << FAN_BITS) | digit
            a, b = np.searchsorted(top, [bucket, bucket + 1])
            for k in range(int(a), int(b), RUN_ROWS):
                yield [node >> FAN_BITS, bucket, *(c[k : min(k + RUN_ROWS, int(b))].tobytes() for c in self.columns())]

    @classmethod
    def of_table(cls, table: pa.Table) -> Run:
        columns = [[np.frombuffer(x.as_buffer(), _DIGEST if n == "digests" else np.int64) for x in table.column(n)] for n in _FIELDS]
        return cls.merged([cls(*c) for c in zip(*columns)])


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUN_ARROW)], schema=_RUN_ARROW)


@trimmed
def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for n, batch in enumerate(batches):
        out, size, mark = [], [], []
        for text in batch.column("text"):
            raw = text.as_buffer().to_pybytes().lower()  # bytes.lower() changes A-Z only
            out.append(hashlib.sha256(raw).digest())
            size.append(len(raw))
            mark.append(xxhash.xxh64_intdigest(raw) - (1 << 63))
        rows = (batch.column("part").cast(pa.int64()).to_numpy() << 40) + (n << 24) + np.arange(len(out))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows), batch.column("row_hash"), pa.array(size, pa.int64()), pa.array(mark, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "row_id", "row_hash", "n_bytes", "mark", "digest"])


@trimmed
def leaf_runs(batches: Iterator[pa.RecordBatch], sign: int) -> Iterator[pa.RecordBatch]:
    """The sorted runs of one partition, dealt to the first round."""
    held: list[Run] = []
    node = 0

    def dealt() -> Iterator[pa.RecordBatch]:
        if held:
            rows = list(Run.merged(held).rows_of(node, 0, 0))
            held.clear()
            if rows:
                yield _batch(rows)

    for batch in batches:
        if not len(batch):
            continue
        node = batch.column("node")[0].as_py()
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        ids = np.where(known, batch.column("doc_id").fill_null(0).to_numpy() * sign, _NO_ID)
        digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), _DIGEST)
        held.append(Run.sorted(digests, ids, batch.column("row_id").to_numpy() * sign, np.ones(len(ids), np.int64), batch.column("n_bytes").to_numpy(), batch.column("mark").to_numpy()))
        if sum(map(len, held)) > 8 * RUN_ROWS:
            yield from dealt()
    yield from dealt()


def merge_node(key: tuple, table: pa.Table, level: int) -> pa.Table:
    rows = list(Run.of_table(table).rows_of(key[0].as_py(), key[1].as_py(), level))
    return pa.Table.from_batches([_batch(rows)] if rows else [], schema=_RUN_ARROW)


def repeated(table: pa.Table, sign: int) -> pa.Table:
    """The last merge: its entries of more than one row."""
    run = Run.of_table(table)
    m = run.counts > 1
    raw = run.digests[m].tobytes()
    ids = pa.array(run.ids[m] * sign, pa.int64(), mask=run.ids[m] == _NO_ID)
    return pa.Table.from_arrays([pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.binary()), ids, pa.array(run.rows[m] * sign), pa.array(run.counts[m])], schema=_GROUPS_ARROW)


def _merger(level: int):
    return lambda key, table: merge_node(key, table, level)


def dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row_hash (xxhash64 of the text as it is)."""
    sign = {"largest": 1, "smallest": -1}[keep]
    source = id_and_text(docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("row_hash"), F.spark_partition_id().alias("part"))
    table = written(source.mapInArrow(digest_rows, _DIGESTS), "digests")
    rounds, parts = 1, table.rdd.getNumPartitions()
    while parts > 1 << (FAN_BITS * rounds):
        rounds += 1
    runs = table.withColumn("node", F.spark_partition_id().cast("bigint")).mapInArrow(lambda it: leaf_runs(it, sign), _RUN)
    for level in range(1, rounds):
        runs = runs.groupBy("node", "bucket").applyInArrow(_merger(level), _RUN)
    groups = runs.groupBy("node", "bucket").applyInArrow(lambda _, table: repeated(table, sign), _GROUPS)
    out = table.join(groups, "digest", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_hash",
    )


DEDUP_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
